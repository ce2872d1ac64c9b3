"""Column types of the tables that the operators read and write."""

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
ORIGIN = "struct<x:double,y:double>"
SPAN = f"struct<text:string,font:string,size:double,flags:int,color:int,bbox:{BBOX},origin:{ORIGIN}>"
RUN = "struct<text:string,bold:boolean,italic:boolean,sup:boolean,noteref:string,href:string>"

#: A line of a page: its spans in order and its box. line_no is the line's place on the page.
LINES = f"book_id string, page_no long, line_no int, spans array<{SPAN}>, x0 double, y0 double, x1 double, y1 double, width double, height double"
IMAGES = "book_id string, page_no long, image_no int, image_id string, ext string, x0 double, y0 double, x1 double, y1 double, px_width int, px_height int"
WORDS = "book_id string, page_no long, word_no int, text string, x0 double, y0 double, x1 double, y1 double, conf double, block_num int, par_num int, line_num int"
ELEMENTS = f"book_id string, seq long, page_no long, kind string, level int, size double, anchor string, runs array<{RUN}>, table_rows array<array<string>>, image_id string"
NOTES = "book_id string, page_no long, ord int, note_id string, label string, text string"
TOC = "book_id string, ord int, level int, title string, page long"
LEXICON = "lang string, word string"

KINDS = ("heading", "paragraph", "blockquote", "image", "caption", "reference", "table", "footnote", "page_break")
PAGE_TYPES = ("unknown", "cover", "title", "copyright", "contents", "prose", "chapter_opening", "bibliography", "index", "table_figure")

#: Bits of a span's flags.
SUPERSCRIPT, ITALIC, SERIF, MONO, BOLD = 1, 2, 4, 8, 16
