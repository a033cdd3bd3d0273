import hashlib
import re

from neo.llm import exact_dedup as X
from tests.llm.conftest import odd_rows


def brute(rows):
    """``doc_id, keep_id, group_size, text_sha256`` of each row, and the number of kept rows."""
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((i, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep[0], len(members), digest) for i, _ in members]
    return sorted(out, key=str), len(groups)


def run(df, **options):
    rows = X.exact_dedup(df, **options).collect()
    winners = [r for r in rows if r.kept]
    assert len({r.text_sha256 for r in winners}) == len(winners)
    assert all(r.doc_id == r.keep_id for r in winners)
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=str), len(winners)


def test_odd_rows(odd, none):
    assert run(odd) == brute([r[:2] for r in odd_rows()])
    assert run(none) == ([], 0)


def test_heavy_and_light_groups(spark):
    rows = [(i, "hot text" + " " * (i % 3)) for i in range(400)] + [(1000 + i, f"text {i // 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for support in (0.002, 0.05, 0.9):
        assert run(df, support=support) == brute(rows)


def test_hot_rows_are_not_shuffled(spark, tmp_path):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    X.digests(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(str(tmp_path / "seen"))
    seen = spark.read.parquet(str(tmp_path / "seen"))
    heavy = X.heavy_winners(seen, 0.1)
    assert heavy.count() == 1
    for side, n in zip(X.split(seen, heavy), (100, 200)):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and side.count() == n


def test_repeated_rows_of_a_hot_group_keep_one(spark):
    df = spark.createDataFrame([(1, "same")] * 50 + [(2, "same")] * 20 + [(3, "x")] * 2, "doc_id long, text string")
    for support in (0.002, 0.9):
        rows = X.exact_dedup(df.repartition(5), support=support).collect()
        assert len(rows) == 72 and sorted(r.doc_id for r in rows if r.kept) == [1, 3]


def test_frequent_digests_are_complete(spark):
    rows = [(f"d{i % 7}" if i % 2 else f"x{i}",) for i in range(2000)]
    got = {r[0] for r in X.frequent_digests(spark.createDataFrame(rows, "digest string").repartition(9), 0.02).collect()}
    assert {f"d{i}" for i in range(7)} <= got and len(got) < 200
