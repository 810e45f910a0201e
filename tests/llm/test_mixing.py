import hashlib

from rillflow.llm import mixing
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    here, there, wrong = differences(mixing.op5_mixing(spark, SF), mixing.mixing_sql(), SF)
    assert here == there > 0 and not wrong


def fill(children, budget):
    """Budgets by handing out the rest again and again: {name: (weight, capacity)}."""
    given = dict.fromkeys(children, 0.0)
    while budget > 1e-6:
        open_ = [c for c in children if children[c][1] - given[c] > 1e-9]
        if not open_:
            break
        whole = sum(children[c][0] for c in open_)
        step = min(budget, min((children[c][1] - given[c]) / children[c][0] * whole for c in open_))
        for c in open_:
            given[c] += step * children[c][0] / whole
        budget -= step
    return given


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 400), ("b", "x", 50), ("b", "z", 20), ("c", "x", 1000)]
    weights = [{"a": 2, "b": 3, "c": 1}, {"x": 1, "y": 2, "z": 5}]
    df = spark.createDataFrame(leaves, "d string, s string, tokens long")
    got = {(r["d"], r["s"]): r["budget"] for r in mixing.budgets(df, ["d", "s"], weights, (1, 2), 1).collect()}
    top = fill({d: (weights[0][d], sum(t for x, _, t in leaves if x == d)) for d in "abc"}, sum(t for *_, t in leaves) // 2)
    for d in "abc":
        low = fill({s: (weights[1][s], t) for x, s, t in leaves if x == d}, top[d])
        for s, b in low.items():
            assert abs(got[d, s] - b) <= 2


def test_odd_rows(spark):
    rows = [(1, "a b c", None, "src1", 9), (1, "a b c", None, "src1", 9), (None, "d e", "en", None, 9), (2, None, "en", "web", 9), (3, "", "en", "src2", 9), (4, "w " * 50_000, "en", "src2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert mixing.chosen(docs).count() == got.count() > 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert docs.select(mixing.n_words(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0] == 50_008


def taken_by_hand(rows, budgets):
    """(doc_id, text, epoch) taken: every equal row for itself, in order of the draws."""
    out = []
    for source in {r[3] for r in rows}:
        mine = [r for r in rows if r[3] == source]
        used = 0
        for epoch in range(mixing.MAX_EPOCHS):
            key = lambda r: hashlib.md5(f"{mixing.SEED}-{epoch}-{r[0] if r[0] is not None else hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
            for r in sorted(mine, key=key):
                if used < budgets[source]:
                    out.append((r[0], r[1], epoch))
                used += len((r[1] or "").split())
    return sorted(out, key=repr)


def test_rows_without_id_and_many_equal_rows(spark):
    rows = [(None, f"text number {i}", "en", "src0") for i in range(300)] + [(None, "the same words", "en", "src0")] * 500 + [(None, "", "en", "src0")] * 20
    rows += [(7, "seven or more words stand in this", "en", "src0")] * 200 + [(i, "a b", "en", "src1") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = mixing.chosen(docs)
    budgets = {r["source"]: r["budget"] for r in got.select("source", "budget").distinct().collect()}
    texts = docs.select(mixing._row_hash(docs).alias("row"), "text").distinct()
    assert sorted(((r["doc_id"], r["text"], r["epoch"]) for r in got.join(texts, "row").collect()), key=repr) == taken_by_hand(rows, budgets)
    plain = sorted(((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect()), key=repr)
    assert plain == sorted(((d, t) for d, t, _ in taken_by_hand(rows, budgets)), key=repr) and len(plain) > 500


def test_long_rows_of_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = spark.createDataFrame([("a", 1), ("b", 7), ("c", 8), ("d", 50)], "name string, times long")
    assert {r["name"]: r["count"] for r in mixing._repeated(rows, "times").groupBy("name").count().collect()} == {"a": 1, "b": 7, "c": 8, "d": 50}
