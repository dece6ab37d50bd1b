"""Exact duplicates: the persistent index against a plain version, over several arrivals."""

import hashlib
import re

from folioforge.llm import dedup

SCHEMA = "doc_id long, text string, digest string, n map<string,int>, rid int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", {"a": 1}, 7) for i, t in rows], SCHEMA)


def _plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((i, t))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(members), sha) for i, _ in members]
    return sorted(out, key=str)


def _got(found):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str)


ROWS = [(5, "a b"), (3, "ab"), (4, "a\t\nb"), (9, "a\x0bb\x0c\r"), (7, "a b"), (8, "a  b"), (1, None), (2, ""), (6, " \n "), (10, "x" * 300_000), (11, "x " * 300_000), (12, "😀 é"), (13, "😀é "), (None, "ab   "), (14, "é")]


def test_matches_a_plain_version(spark):
    got = dedup.exact_duplicates(_docs(spark, ROWS)).collect()
    assert _got(got) == _plain(ROWS)
    for r in got:
        assert r.kept == (r.doc_id == r.keep_id)


def test_repeated_rows_keep_exactly_one(spark):
    rows = [(1, "same"), (1, "same"), (1, "sa me"), (1, "sa me"), (2, "same"), (None, "q"), (None, "q")]
    got = dedup.exact_duplicates(_docs(spark, rows).repartition(3)).collect()
    assert _got(got) == _plain(rows)
    assert sorted((str(r.doc_id), r.text_sha256) for r in got if r.kept) == sorted([("1", got_sha("same")), ("None", got_sha("q"))])


def got_sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert dedup.exact_duplicates(_docs(spark, [])).count() == 0


def test_arrivals_meet_in_one_index(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    first, second = dedup.digests(_docs(spark, ROWS[:6])), dedup.digests(_docs(spark, ROWS[6:] + [(20, "a   b   "), (21, "new")]))
    index = dedup.DigestIndex(spark, folder, buckets=3)
    assert index.admit(first, "one").count() == 2  # four spellings of one text, two of another
    fresh = {r.digest.hex() for r in index.admit(second, "two").collect()}
    old = {s for *_, s in _plain(ROWS[:6])}
    assert fresh == {s for *_, s in _plain(ROWS[6:] + [(20, "a   b   "), (21, "new")])} - old
    before = index.entries().count()
    assert {r.digest.hex() for r in index.admit(second, "two").collect()} == fresh and index.entries().count() == before
    index.close()
    again = dedup.DigestIndex(spark, folder)  # opened by its folder: the buckets are those it was made with
    assert again.buckets == 3
    want = {(k, n, s) for _, k, n, s in _plain(ROWS + [(20, "a   b   "), (21, "new")])}
    assert {(r.doc_id, r.n, r.digest.hex()) for r in again.groups().collect()} == want
    again.close(remove=True)


def test_plan_joins_by_merge_without_python(spark, tmp_path):
    index = dedup.DigestIndex(spark, f"file://{tmp_path}/plan", buckets=4)
    slim = dedup.digests(_docs(spark, ROWS))
    index.admit(slim, "one")
    joined = slim.repartition(4, "digest").join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # none on the index's side
    everything = dedup.exact_duplicates(_docs(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in everything and "Arrow" not in everything


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert _got(dedup.exact_duplicates(docs).collect()) == _plain(rows)
