from pyspark.sql import functions as F

from trelliq.catalog import Catalog, Column, ForeignKey, TableMeta
from trelliq.functions import text, vectors
from trelliq.operators import decisions, evaluation, retrieval, sampling


def names(*n):
    return tuple(map(Column, n))


def test_words(spark):
    got = spark.createDataFrame([("confMembers_people-pc Studies",), ("",), (None,), ("Chairman",)], "t string").select(text.word_set(F.col("t"))).collect()
    assert set(got[0][0]) == {"conf", "conference", "members", "member", "people", "person", "pc", "program", "committee", "studies", "study", "studie"}
    assert got[1][0] == [] and got[2][0] == [] and set(got[3][0]) == {"chairman", "chair"}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.safe_fragment(F.lit("--")).alias("a"), text.safe_fragment(F.lit("a b-c")).alias("b"), text.unescape(F.lit(r"x\ny\\n")).alias("c"), text.local_name(F.lit("http://x/y/")).alias("d"),
        text.local_name(F.lit("http://x#y")).alias("e"), text.similarity(F.lit(""), F.lit("")).alias("f"), text.similarity(F.lit(""), F.lit("a")).alias("g"), text.compact(F.lit("a  b\n" + "c" * 20), 10).alias("h"),
        text.identifier_like(F.lit("a b")).alias("i"), text.identifier_like(F.lit("A12")).alias("j"), text.normalize_uri(F.lit("<ex:a>"), {"ex": "urn:"}).alias("k"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == ("id", "a_b_c", "x\ny\\\n" if row.c.endswith("\n") else row.c, "y", "y", 1.0, 0.0)
    assert row.h == "a b ccc..." and not row.i and row.j and row.k == "urn:a"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] == 0.0
    bad = spark.createDataFrame([([1.0, float("nan")],), ([],), ([1.0],), ([1.0, 2.0],)], "v array<double>").select(vectors.vector_issue(F.col("v"), 2)).collect()
    assert [r[0] for r in bad] == ["not_finite", "empty", "dimension_mismatch", None]
    e = vectors.hash_embedding(spark.createDataFrame([(1, "a a b")], "k int, t string"), "k", "t").agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    assert abs(e - 1) < 1e-12


CITY = Catalog.of([TableMeta("province", names("name", "country"), ("name", "country")), TableMeta("city", names("name", "country", "province"), ("name", "country", "province"), (ForeignKey(("country", "province"), "province", ("country", "name")),))])


def test_sample_pulls_parents(spark):
    frames = {"province": spark.createDataFrame([("Albania", "AL"), ("Other", "XX")], "name string, country string"), "city": spark.createDataFrame([("Tirana", "AL", "Albania")], "name string, country string, province string")}
    for seed in map(str, range(12)):
        kept = sampling.closed_sample(CITY, frames, 0.5, seed)
        cities, provinces = kept["city"].count(), {r.name for r in kept["province"].collect()}
        assert not cities or "Albania" in provinces
    whole = sampling.closed_sample(CITY, {"province": frames["province"].union(frames["province"])}, 1.0, "x")
    assert whole["province"].count() == 4


def test_sample_without_key_and_self_reference(spark):
    cat = Catalog.of([TableMeta("node", names("id", "up"), ("id",), (ForeignKey(("up",), "node", ("id",)),))])
    df = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(12)], "id string, up string")
    kept = {r.id for r in sampling.closed_sample(cat, {"node": df}, 0.2, "s")["node"].collect()}
    assert kept and all(str(i) in kept for i in range(max(map(int, kept)) + 1))
    sea = Catalog.of([TableMeta("sea", names("name"), ("name",)), TableMeta("islandin", names("island", "sea", "lake"), (), (ForeignKey(("sea",), "sea", ("name",)),))])
    frames = {"sea": spark.createDataFrame([("A",), ("B",)], "name string"), "islandin": spark.createDataFrame([("i", "A", None), ("i", "B", None)], "island string, sea string, lake string")}
    for seed in "abc":
        kept = sampling.closed_sample(sea, frames, 0.5, seed)
        assert {r.sea for r in kept["islandin"].collect()} <= {r.name for r in kept["sea"].collect()}


def test_ranks_and_fusion(spark):
    rows = spark.createDataFrame([("s", "b", 0.5), ("s", "a", 0.5), ("s", "c", 0.9)], "source string, target string, score double")
    one = retrieval.ranked(rows, "source", "target", F.col("score"))
    assert [(r.target, r["rank"]) for r in one.orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    scaled = retrieval.ranked(rows.withColumn("score", F.col("score") * 7), "source", "target", F.col("score"))
    a, b = (retrieval.fuse([x, one], "source", "target").orderBy("target").collect() for x in (one, scaled))
    assert a == b


def test_metrics(spark):
    ranks = spark.createDataFrame([("s", f"t{i}", i) for i in range(1, 31)], "source string, target string, rank int")
    gold = spark.createDataFrame([("s", "t5"), ("s", "t9"), ("u", "t1"), ("v", "t25")], "source string, target string")
    d = evaluation.first_ranks(ranks.unionByName(ranks.withColumn("source", F.lit("v"))), gold, "source", "target")
    got = {r.source: r for r in d.collect()}
    assert got["s"].first_rank == 5 and abs(got["s"].reciprocal_rank - 0.2) < 1e-12 and [got["s"][f"found_at_{k}"] for k in evaluation.K_VALUES] == [0, 0, 1, 1, 1, 1, 1]
    assert got["u"].first_rank is None and got["u"].candidate_count == 0 and got["v"].rank_anywhere == 25 and got["v"].first_rank is None


def test_membership(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    r = evaluation.membership_scores(f("a", "b"), f("a", "c")).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    r = evaluation.membership_scores(f("a", "a", "b"), f("a")).first()
    assert abs(r.precision - 2 / 3) < 1e-12 and r.recall == 1
    r = evaluation.membership_scores(f(), f()).first()
    assert (r.precision, r.recall, r.f1) == (1, 1, 1)


def test_votes(spark):
    s = spark.createDataFrame([("s", "email", 0.9), ("s", "title", 0.7), ("t", "x", 0.1), ("t", None, 0.2)], "src string, predicted string, confidence double")
    ranks = spark.createDataFrame([("s", "email", 1), ("s", "title", 2)], "src string, predicted string, rank int")
    got = {r.src: r for r in evaluation.majority_votes(s, "src", ranks).collect()}
    assert got["s"].predicted == "email" and got["s"].tie and got["s"].disagreement == 0.5 and got["t"].predicted is None


def test_providers(spark):
    c = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "source string, target string, rank int")
    assert decisions.FirstCandidate().decide(c).first().target == "a"
    rec = decisions.Recorded(spark.createDataFrame([("s", "NULL", 0.9)], "source string, target string, confidence double"))
    assert rec.decide(c).first().target is None
