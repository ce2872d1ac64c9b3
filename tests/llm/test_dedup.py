import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.llm.components import components
from quire.llm.line_dedup import _among, deduplicate_lines, without_lines
from quire.llm.near_dedup import deduplicated, near_duplicates
from quire.llm.suffix_dedup import STRETCH, repeated_strings
from tests.llm.helpers import bag, docs, edited, prose, tokens
from tests.llm.helpers import components as plain_components


def removed_bytes(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def strings(spark, texts, **how):
    rows = repeated_strings(docs(spark, texts), **how).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


@pytest.fixture(scope="module")
def repeated():
    a, shared = prose(300, 1), prose(40, 2)
    texts = {0: a, 5: a, 7: "é" + a, 8: prose(100, 3) + shared + prose(60, 4), 9: shared + prose(50, 5) + shared, 10: None, 11: "", 12: "short", 13: "short", 14: "x" * 500, 15: "x" * 99, 16: "x" * 100, 17: "ab" * 300, 18: shared[:100], 19: shared[:99], -3: prose(20, 6) + shared, 2**40: a[:250] + "!"}
    return texts


def test_repeated_strings(spark, repeated):
    assert strings(spark, repeated) == removed_bytes(repeated)


def test_frequent_grams_go_the_other_way(spark, repeated):
    assert strings(spark, repeated, hot=1) == removed_bytes(repeated)


def test_partitions_in_slices(spark, repeated, monkeypatch):
    import pyarrow as pa

    from quire.llm import suffix_dedup as S

    rows = [(h, d, s, 1, bytes([h]) * 100) for h in range(5) for d in range(7) for s in (0, 3)]
    table = pa.table({"h": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "start": pa.array([r[2] for r in rows], pa.int32()), "span": pa.array([r[3] for r in rows], pa.int16()), "context": pa.array([r[4] for r in rows], pa.binary())})
    got = S._repeats_of(table)
    assert got.num_rows == 5 * 13 and (0, 0) not in set(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    taken = []

    class Frame:
        def repartition(self, *a):
            return self

        def mapInArrow(self, f, schema):
            taken.extend(f(table.to_batches()))

    monkeypatch.setattr(S, "PARTITION_ANCHORS", 20)
    S._repeats(Frame(), 1)
    assert len(taken) > 1 and sum(b.num_rows for b in taken) == got.num_rows


def test_very_long_text(spark):
    part = prose(60, 9)
    long = prose(STRETCH // 5, 10, 10**6) + part + prose(STRETCH // 5, 11, 10**6) + part
    texts = {0: long, 1: part + "?"}
    assert len(long.encode()) > STRETCH
    assert strings(spark, texts) == removed_bytes(texts)


def test_rows_without_or_with_the_same_id(spark):
    text = prose(50, 1)
    got = repeated_strings(docs(spark, {1: text}).unionByName(docs(spark, {1: text})).unionByName(docs(spark, {None: text, 2: prose(40, 2)}))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in got) == [(False, 1, False), (False, 1, False), (False, 2, False), (True, 0, True)]
    assert repeated_strings(docs(spark, {})).count() == 0


# --- near duplicates --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def family():
    base = [prose(120, s) for s in range(4)]
    texts = {}
    for k, b in enumerate(base):
        texts[k] = b
        texts[10 + k] = b.upper()
        for v in range(12):
            texts[100 * (k + 1) + v] = edited(b, 20 + 8 * v, v)
            texts[1000 * (k + 1) + v] = edited(texts[100 * (k + 1) + v], 30, v + 50)
    texts |= {5000: None, 5001: "", 5002: " \t\n", 5003: "one two", 5004: "One  two", 5005: "one two three four", 5006: "one", 5007: base[0] + " " + base[1], 5008: "a b c d e f", 5009: "a b c d e f", 5010: "a b c d e f g h"}
    return texts


def test_near_duplicates(spark, family):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark, family)).collect()}
    sets = {i: set(bag(tokens(t))) for i, t in family.items()}
    top = plain_components(sets)
    assert got == {i: (len(sets[i]), top[i], top[i] == i) for i in family}
    assert len({c for _, c, _ in got.values()}) < len(got)


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(docs(spark, {})).count() == 0
    text = prose(30, 1)
    twice = docs(spark, {1: text, 2: text}).unionByName(docs(spark, {1: text})).unionByName(docs(spark, {None: text}))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(twice).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_several_texts_under_one_id(spark):
    a, b, c, d = (prose(60, 900 + k) for k in range(4))
    rows = [(5, a), (5, b), (5, b), (9, edited(a, 60, 1)), (7, edited(b, 60, 2)), (3, c), (4, d), (4, c), (8, d), (12, a), (20, None), (20, d), (21, None), (None, a)]
    sets = [set(bag(tokens(t))) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for j, (x, _) in enumerate(rows):
            for k, (y, _) in enumerate(rows):
                common = len(sets[j] & sets[k])
                if x is not None and y is not None and common and 100 * common >= 75 * len(sets[j] | sets[k]):
                    up[x] = up[y] = min(up[x], up[y])
    want = sorted((i or 0, len(s), up.get(i) or 0, i is None or up[i] == i) for (i, _), s in zip(rows, sets, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df).collect()) == want
    assert {up[i] for i in up} == {3, 5, 21}
    assert {r.doc_id for r in deduplicated(df).collect()} == {3, 5, 21, None}


def test_deduplicated_keeps_columns(spark):
    text = prose(30, 1)
    df = docs(spark, {1: text, 2: text + " end", 3: None, 4: prose(30, 2)})
    got = deduplicated(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(50, 60), (60, 70), (99, 99), (70, 50)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {60: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


# --- lines ------------------------------------------------------------------------------------------


def later_lines(texts):
    earlier, out = [], {}
    for i in sorted(texts):
        out[i] = []
        for k, t in enumerate((texts[i] or "").split("\n") if texts[i] is not None else []):
            s = set(t.replace("\t", " ").replace("\r", " ").split(" ")) - {""}
            if s and any(100 * len(s & e) >= 75 * len(s | e) for e in earlier):
                out[i].append(k)
            earlier.append(s)
    return out


@pytest.fixture(scope="module")
def lined():
    base = [prose(n, n) for n in (3, 4, 8, 12, 30, 60, 130)]
    texts = {10 * k: "\n".join([*base[k:], prose(15, k + 900)]) for k in range(len(base))}
    texts |= {10 * k + 1: "\n".join(edited(b, 9 + k, k) for b in base) for k in range(6)}
    texts |= {10 * k + 2: "\n".join(edited(b, 25, k + 70) + "\t" + b.split(" ")[0] for b in base) for k in range(4)}
    return texts | {500: None, 501: "", 502: "\n\n", 503: "a b c\r\na b c d\n a  b\tc", 504: "a\nb\na", -7: base[3] + "\n" + base[3], 2**58: base[5]}


def test_lines(spark, lined):
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed)) for r in deduplicate_lines(docs(spark, lined)).collect()}
    want = later_lines(lined)
    assert got == {i: (0 if t is None else t.count("\n") + 1, len(want[i]), want[i]) for i, t in lined.items()}


def test_lines_are_taken_out(spark, lined):
    df = docs(spark, lined)
    got = without_lines(df, deduplicate_lines(df))
    want = later_lines(lined)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in lined.items()}


def test_lines_of_odd_tables(spark):
    assert deduplicate_lines(docs(spark, {})).count() == 0
    got = deduplicate_lines(docs(spark, {None: "a b\na b", 1: "a b"})).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0)]


def test_lines_of_rows_that_share_a_doc_id(spark):
    rows = [(1, "a b c d\nq r s t"), (1, "a b c d\nu v w x"), (1, "a b c d\nq r s t"), (2, "u v w x\nq r s t\nk l m n"), (3, "k l m n")]
    got = deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, tuple(r.removed)) for r in got} == {(1, ()), (2, (0, 1)), (3, (0,))} and len(got) == 5


def test_lines_stay_native(spark, lined):
    plan = deduplicate_lines(docs(spark, lined))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_lines_of_a_large_group_and_a_common_word(spark):
    # near copies of one line, at most of which the first of the group is not similar to; one word in nearly all lines
    base = prose(40, 7)
    texts = {i: f"{edited(base, 9, i)}\nthe {prose(12, 1000 + i, 30)}" for i in range(60)}
    texts[60] = "the " + prose(400, 5)
    got = {r.doc_id: list(r.removed) for r in deduplicate_lines(docs(spark, texts)).collect()}
    assert got == later_lines(texts) and any(got.values()) and any(not x for i, x in got.items() if i)


def test_lines_of_rows_that_share_a_doc_id_and_are_similar_to_others(spark):
    # line 0 of document 1 has two sets, each similar to another document's line
    a, b = prose(40, 11), prose(40, 12)
    rows = [(1, a), (1, b), (2, edited(a, 25, 3)), (3, edited(b, 25, 4))]
    got = deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, tuple(r.removed)) for r in got) == [(1, ()), (1, ()), (2, (0,)), (3, (0,))]


def test_lines_of_ids_without_room_for_line_numbers(spark):
    base = [prose(n, n) for n in (8, 30, 60)]
    texts = {2**62: "\n".join(base), 2**62 + 1: "\n".join([edited(base[1], 25, 1), base[2], prose(20, 5), base[0]]), -(2**62): base[2]}
    got = {r.doc_id: list(r.removed) for r in deduplicate_lines(docs(spark, texts)).collect()}
    assert got == later_lines(texts) and sum(map(len, got.values())) == 4


def test_settled_steps_leave_no_shuffles(spark):
    scratch = Scratch(spark, "settled")
    live = lambda: set(re.findall(r"\d+", str(spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys())))
    scratch.settle()
    before = live()
    scratch.save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    scratch.settle()
    time.sleep(1)
    assert live() <= before


def test_documents_without_wanted_lines_are_left_out(spark):
    ids = spark.createDataFrame([(7 * i - 100,) for i in range(50)], "d long")
    got = {r.id for r in spark.range(-1000, 20000).where(_among("id", ids, 50)).collect()}
    assert got >= {7 * i - 100 for i in range(50)} and len(got) < 4000
