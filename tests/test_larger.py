"""Queries against their SQL on keys and values that only larger tables have."""

from __future__ import annotations

import hashlib

import duckdb

from tests import compare
from vellumspark.operators import library, match, metrics
from vellumspark.plans import catalogue


def check(spark, path, name: str, **made: str) -> None:
    """The query on tables that some SQL makes, against its own SQL."""
    for table, sql in made.items():
        duckdb.execute(f"COPY ({sql}) TO '{path}/{table}.parquet' (FORMAT parquet)")
    compare.same(catalogue.queries()[name](spark, str(path)), compare.connection(str(path)), catalogue.oracle_sql()[name])


def test_claims_of_late_conversations(spark, tmp_path):
    check(spark, tmp_path, "claim_check", conversations="SELECT c.v AS conv_id, t AS turn, 'x' AS text FROM (VALUES (7::BIGINT), (1000), (8999), (9000), (14130), (123456)) c(v), range(12) r(t)")


def test_keys_say_no_year(spark, tmp_path):
    check(spark, tmp_path, "safe_names", part="SELECT v AS p_partkey, 'blue bolt' AS p_name FROM (VALUES (2024::BIGINT), (12024), (20210), (20214), (32023), (2023), (20231), (20243), (8), (9)) p(v)")


def test_halves_as_doubles_tell(spark, tmp_path):
    # 72 words of 129 syllables in 28 sentences: a reading ease of 52.650000000000006; 120, 359, 20: -52.349999999999994
    rows = []
    for doc, words, sentences, syllables in ((1, 72, 28, 129), (2, 120, 20, 359), (3, 99, 21, 110), (4, 168, 12, 497)):
        much = ["a" + "ba" * (syllables // words - 1)] * words
        for k in range(syllables % words):
            much[k] += "ba"
        for k in range(sentences):
            much[-1 - k] += "."
        rows.append(f"({doc}, '{' '.join(much)}')")
    check(spark, tmp_path, "flagship", documents=f"SELECT d::BIGINT AS doc_id, t AS text FROM (VALUES {', '.join(rows)}) v(d, t)")


def test_pairs_of_one_paper_are_never_exchanged(spark):
    papers = [(p, f"i{(p * k) % 5}" if p % 3 else "", f"T {(p + k) % 4}" if p % 2 else None) for p in range(40) for k in range(3)] + [(None, "i1", "T 1"), (99, "", "")]
    jobs = [(j, f"i{(j + k) % 7}" if j % 4 else None, f"t-{(j * k) % 6}") for j in range(50) for k in range(2)] + [(None, "i1", ""), (98, "", "?")]
    alike = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    want = {(p, j) for p, i, t in papers for j, x, y in jobs if (i and i == x) or (alike(t) and alike(t) == alike(y))}
    made = lambda rows, who: spark.createDataFrame(rows, f"{who} int, preprint string, title string")
    found = library.same_paper(made(papers, "paper"), made(jobs, "job"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan.split("Aggregate")[0]  # nothing aggregates pairs


def shuffled(spark) -> int:
    """Bytes that the session's stages have written for exchanges."""
    gate, empty = spark.sparkContext._gateway, spark._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(empty(), False, False, gate.new_array(gate.jvm.double, 0), empty())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_a_set_does_not_travel_with_each_of_its_pairs(spark, monkeypatch):
    # 30 near copies of one long text, a few tiny sets and other texts: as many links as brute force, little in exchanges
    monkeypatch.setattr(metrics, "SLOTS", 1 << 10)
    name = lambda k: hashlib.sha1(str(k).encode()).hexdigest()[:16]
    sets = [{name(k) for k in range(3000) if (k * 7 + d) % 90} | {name(10000 + d)} for d in range(30)]
    sets += [{name(k) for k in range(d, d + 3)} for d in range(5)] + [{name(20000 + d)} for d in range(3)] + [{name(k) for k in range(30000 + 9 * d, 30040 + 9 * d)} for d in range(20)]
    rows = [(d, "en", sorted(s)) for d, s in enumerate(sets)]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the sets are many
    try:
        got = metrics.similar_sets(spark.createDataFrame(rows, "d long, lang string, set array<string>"), "d", ["lang"], 0.6)[1].collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 435
    assert all(abs(r["similarity"] - len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]])) < 1e-12 for r in got)
    assert shuffled(spark) - before < 8_000_000


def test_only_asked_tokens_and_characters_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(match, "SLOTS", 1 << 10, raising=False)
    word = lambda k: "".join(chr(97 + int(c, 16)) for c in hashlib.sha1(str(k).encode()).hexdigest()[:9])
    rows = [(d, " ".join(word(d * 1000 + k) for k in range(1000))) for d in range(60)]
    passages = [(d, " ".join(word(d * 1000 + k) for k in range(500, 506))) for d in range(0, 60, 7)] + [(100, "no such passage here at all")]
    docs, asked = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(passages, "item_id int, text string")
    before = shuffled(spark)
    assert {tuple(r) for r in match.containing(asked, docs, "item_id", "doc_id").collect()} == {(d, d) for d in range(0, 60, 7)}
    assert shuffled(spark) - before < 1_500_000
