import itertools
import math
import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from caudal.operators import compare, dedup, graph, linkage, metrics, references, skew

DAY = lambda n: datetime(2025, 1, n)


def targets(spark, data):
    df = spark.createDataFrame(data, "a string, b string, t timestamp, gone timestamp")
    return references.target_state(df, [F.col("a"), F.col("b")], "t", "gone", ["a", "b"])


REFS = [(1, "x", "y", DAY(5)), (2, "x", None, DAY(5)), (3, None, None, DAY(5)), (4, "q", None, DAY(5)), (5, "z", "z", DAY(5)), (6, "d", "d", DAY(5)), (7, "l", "l", DAY(5)), (1, "x", "y", DAY(5))]
TARGETS = [("x", "y", DAY(1), None), ("x", "w", DAY(1), None), ("d", "d", DAY(1), DAY(2)), ("l", "l", DAY(9), None), (None, None, DAY(1), None)]


@pytest.mark.parametrize(
    "match, want",
    [
        ("simple", [(5, "ausente"), (6, "borrada"), (7, "tardia")]),
        ("partial", [(4, "ausente"), (5, "ausente"), (6, "borrada"), (7, "tardia")]),
        ("full", [(2, "ausente"), (4, "ausente"), (5, "ausente"), (6, "borrada"), (7, "tardia")]),
    ],
)
def test_match_semantics(spark, match, want):
    refs = spark.createDataFrame(REFS, "id int, p string, q string, w timestamp")
    out = references.dangling(refs, ["p", "q"], targets(spark, TARGETS), ["a", "b"], match, when="w")
    assert rows(out.select("id", "motivo")) == want


def test_references_without_rows_and_with_clashing_names(spark):
    refs = spark.createDataFrame(REFS, "desde int, a string, b string, w timestamp")
    none = targets(spark, TARGETS).limit(0)
    assert {r["motivo"] for r in references.dangling(refs, ["a", "b"], none, ["a", "b"], "simple", when="w").collect()} == {"ausente"}
    assert references.dangling(refs.limit(0), ["a", "b"], none, ["a", "b"], "partial").count() == 0
    with pytest.raises(ValueError):
        references.dangling(refs, ["a"], none, ["a"], "some")


def test_first_delivery_and_levelling(spark):
    df = spark.createDataFrame([("k", DAY(2), "b"), ("k", DAY(1), " Ab1 "), ("k", None, "c"), (None, DAY(1), "d")], "id string, t timestamp, v string")
    got = references.first_delivery(df, "id", "t", ["v"]).select("id", references.levelled_reference(F.col("v")))
    assert rows(got) == [("k", "AB1")]
    texts = spark.createDataFrame([("sin número",), ("",), (" co1 \n",)], "v string")
    assert [r[0] for r in texts.select(references.levelled_reference(F.col("v"))).collect()] == [None, None, "CO1"]


def edges(spark, seed=1):
    rnd = random.Random(seed)
    data = [("adjudica", "HUB" if rnd.random() < 0.3 else f"E{rnd.randrange(300)}", f"S{rnd.randrange(40)}", 1, 2.0) for _ in range(2000)]
    data += [("integra", f"S{rnd.randrange(40)}", f"S{rnd.randrange(40)}", None, None) for _ in range(150)] + [("adjudica", None, "S1", 1, 1.0), ("adjudica", "E1", None, 1, 1.0)]
    return data, spark.createDataFrame(data, "tipo string, origen string, destino string, peso long, valor double")


def test_heavy_keys_and_totals(spark):
    data, df = edges(spark)
    want = sorted((s, k) for s, i in (("origen", 1), ("destino", 2)) for k in {r[i] for r in data} - {None} if sum(r[i] == k for r in data) >= 0.01 * len(data))
    assert rows(skew.heavy_keys(df, ["origen", "destino"], 0.01).select("extremo", "clave")) == want
    totals = {(r["extremo"], r["clave"]): (r["n_filas"], r["peso_total"], r["pesada"]) for r in skew.totals_by_end(df, ["origen", "destino"], "peso", "valor").collect()}
    for (side, key), (n, w, heavy) in totals.items():
        own = [r for r in data if r[1 if side == "origen" else 2] == key]
        assert n == len(own) and (w or 0) == sum(r[3] or 0 for r in own) and heavy == (((side, key)) in want)
    assert skew.heavy_keys(df.limit(0), ["origen", "destino"]).count() == 0
    assert skew.totals_by_end(df.limit(0), ["origen", "destino"], "peso", "valor").count() == 0


def test_triangles_by_brute_force(spark):
    data, df = edges(spark)
    awards = {(r[1], r[2]) for r in data if r[0] == "adjudica" and r[1] and r[2]}
    members = {(r[1], r[2]) for r in data if r[0] == "integra" and r[1] != r[2]}
    want = sorted((e, u, m) for u, m in members for e in {a for a, s in awards if s == u} if (e, m) in awards)
    assert rows(skew.risk_triangles(df, "tipo", "origen", "destino")) == want
    by = {(r[0], r[1]): r[2] for r in skew.triangles_by_key(df, "tipo", "origen", "destino").collect()}
    assert by[("entidad", "HUB")] == sum(t[0] == "HUB" for t in want)


def graph_of(spark, n=60, m=90, seed=3):
    rnd = random.Random(seed)
    pairs = [(f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}") for _ in range(m)]
    return pairs, graph.undirected(spark.createDataFrame([*pairs, (None, "v1"), ("v1", "v1")], "x string, y string"), "x", "y")


def test_components_and_triangles(spark):
    pairs, und = graph_of(spark)
    leader = {}

    def find(v):
        while leader.setdefault(v, v) != v:
            v = leader[v]
        return v

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            leader[y] = x
    want = {(v, find(v)) for a, b in pairs if a != b for v in (a, b)}
    assert rows(graph.components(und)) == sorted(want, key=repr)
    simple = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    names = sorted({v for p in simple for v in p})
    want = sum(1 for t in itertools.combinations(names, 3) if all(p in simple for p in itertools.combinations(t, 2)))
    assert graph.triangles(und).count() == want
    assert graph.components(und.limit(0)).count() == 0


def test_pagerank_sums_to_one_and_converges(spark):
    _, und = graph_of(spark)
    ranks = graph.pagerank(und)
    assert abs(ranks.agg(F.sum("rank")).first()[0] - 1) < 1e-3
    assert graph.pagerank(und.limit(0)).count() == 0


def test_modularity_of_two_cliques(spark):
    pairs = [(a, b) for g in ("a", "b") for a, b in itertools.combinations([f"{g}{i}" for i in range(4)], 2)] + [("a0", "b0")]
    und = graph.undirected(spark.createDataFrame(pairs, "x string, y string"), "x", "y")
    labels = graph.communities(und)
    by = {r["id"]: r["comunidad"] for r in labels.collect()}
    assert len({by[f"a{i}"] for i in range(4)}) == 1 and by["a1"] != by["b1"]
    q = graph.modularity(und, labels, "comunidad").first()["modularidad"]
    assert abs(q - (12 / 13 - 2 * (13 / 26) ** 2)) < 1e-9


def test_communities_come_to_rest(spark):
    pairs = [("a", "b"), *[("hub", f"leaf{i}") for i in range(5)]]
    und = graph.undirected(spark.createDataFrame(pairs, "x string, y string"), "x", "y")
    by = {r["id"]: r["comunidad"] for r in graph.communities(und).collect()}
    assert by["a"] == by["b"] == "a" and len({c for i, c in by.items() if i not in "ab"}) == 1
    with pytest.raises(RuntimeError):
        graph.communities(und, rounds=1)


def test_communities_of_planted_groups(spark):
    """Twelve dense groups with few links between them come out whole, each named by its smallest id."""
    rnd = random.Random(2)
    pairs = [(a, b) for g in range(12) for a, b in itertools.combinations([f"{g:02}-{i}" for i in range(10)], 2) if rnd.random() < 0.6]
    pairs += [(f"{rnd.randrange(12):02}-{rnd.randrange(10)}", f"{rnd.randrange(12):02}-{rnd.randrange(10)}") for _ in range(40)]
    und = graph.undirected(spark.createDataFrame(pairs, "x string, y string"), "x", "y")
    labels = graph.communities(und)
    assert {(r["id"][:2], r["comunidad"]) for r in labels.collect()} == {(f"{g:02}", f"{g:02}-0") for g in range(12)}
    assert graph.communities(und.limit(0)).count() == 0


def test_equal_rows_keep_their_salt(spark):
    df = spark.createDataFrame([("k", i % 3, 1.0) for i in range(600)] + [(None, 1, None)], "key string, v int, x double")
    heavy = skew.heavy_candidates(df.withColumn("s", F.lit("s")), "s", "key", 0.1).select("key")
    out = skew.salted_aggregate(df, ["key"], {"n": F.count(F.lit(1)), "x": F.sum("x")}, {"n": F.sum("n"), "x": F.sum("x")}, heavy)
    assert rows(out) == [(None, 1, None), ("k", 600, 600.0)] or rows(out) == [("k", 600, 600.0), (None, 1, None)]


def test_replicates_against_sorted_ranks(spark):
    """Each replicate's AUC is that of its weighted rows, ties sharing their average rank."""
    import hashlib

    rnd = random.Random(5)
    data = [(f"i{i}", rnd.randrange(2), rnd.choice([0.0, 0.1, 0.25, 0.2501, 0.9, 1.0])) for i in range(80)]
    got = {r["r"]: r["auc"] for r in metrics.bootstrap(spark.createDataFrame(data, "id string, y int, p double"), 16).collect()}
    assert sorted(got) == list(range(16))
    for r in (0, 7, 8, 15):
        pos, neg = [], []
        for i, y, p in data:
            h = hashlib.md5(f"b|{r // 8}|{i}".encode()).hexdigest()
            u = int(h[4 * (r % 8) : 4 * (r % 8) + 4], 16)
            (pos if y else neg).extend([p] * sum(u >= math.ceil(c * 65536) for c in metrics.POISSON))
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[r] - want) < 1e-9


def test_k_core(spark):
    und = graph.undirected(spark.createDataFrame([*itertools.combinations("abcd", 2), ("d", "e"), ("e", "f")], "x string, y string"), "x", "y")
    assert rows(graph.k_core(und, 3).select("a", "b")) == sorted(itertools.combinations("abcd", 2))


def test_propagation_equals_projection(spark):
    a = [("e1", "p"), ("e1", "q"), ("e1", "r"), ("e2", "p"), ("e2", "q"), ("e3", "s")]
    x = {"p": 1.0, "q": 2.0, "r": 4.0, "s": 8.0}
    got = {r["actor"]: (r["vecinos"], r["x_vecinos"]) for r in graph.propagate(spark.createDataFrame(a, "entidad string, actor string"), spark.createDataFrame(list(x.items()), "actor string, x double"), ["x"]).collect()}
    assert got == {"p": (3, (2 + 4 + 2) / 3), "q": (3, (1 + 4 + 1) / 3), "r": (2, 1.5), "s": (0, 0.0)}


def test_metrics_closed_form(spark):
    pred = [("a", 1, 0.9), ("b", 0, 0.8), ("c", 1, 0.8), ("d", 0, 0.1), ("e", 1, 1.0), ("f", 0, 0.1)]
    df = spark.createDataFrame(pred, "id string, y int, p double")
    pos, neg = [p for _, y, p in pred if y], [p for _, y, p in pred if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 9
    m = metrics.auc_and_precision(df).first()
    assert abs(m["auc"] - auc) < 1e-12
    assert abs(m["precision_media"] - (1 + 1 + 3 / 4) / 3) < 1e-12
    assert [(r["k"], r["aciertos"]) for r in metrics.top(df, [2, 3]).orderBy("k").collect()] == [(2, 2), (3, 2)]
    assert metrics.reliability(df).where("tramo = 9").first()["n"] == 2
    assert metrics.best_f1(df).first()["umbral"] == 0.8
    assert metrics.auc_and_precision(df.limit(0)).first()["auc"] is None
    part = metrics.split(df, "id", "y")
    assert part.where("prueba and pliegue is not null").count() == 0


def test_dedup(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 3), (None, None, 1), (None, None, 2)], "a int, b int, v int")
    assert rows(dedup.smallest_per_key(df, ["a", "b"], ["v"])) == sorted([(1, None, 3), (None, None, 1)], key=repr)
    assert dedup.repeated_keys(df, ["a", "b"]).count() == 2


def test_training_finds_the_matches():
    c = [linkage.Comparison("x", "x", (linkage.exact,)), linkage.Comparison("z", "z", (linkage.exact,))]
    u = {"x": [0.95, 0.05], "z": [0.9, 0.1]}
    counts = []
    for gx in (0, 1):
        for gz in (0, 1):
            m = 200 * (0.9 if gx else 0.1) * (0.8 if gz else 0.2)
            counts.append({"g_x": gx, "g_z": gz, "n": m + 800 * u["x"][gx] * u["z"][gz]})
    share, m = linkage.train(counts, c, u, rounds=500)
    assert abs(share - 0.2) < 0.02 and abs(m["x"][1] - 0.9) < 0.05 and abs(m["z"][1] - 0.8) < 0.05


def test_blocking_limit(spark):
    df = spark.createDataFrame([(i, "k") for i in range(10)], "id int, k string")
    with pytest.raises(ValueError):
        linkage.audited(df, {"k": F.col("k")}, 10)


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 1.0, "z")], "k int, v double, t string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, 2.1, None), (4, 1.0, "z")], "k int, v double, t string")
    assert rows(compare.compare_tables(a, b, ["k"])) == [("t", 2, 0, 1, 1), ("v", 1, 1, 1, 1)]


def test_coalition_values_add_up(spark):
    """Values of a row add up to its score less the mean score; a feature without weight gets nothing; equal features share."""
    rnd = random.Random(3)
    base = [[rnd.random() for _ in range(4)] for _ in range(20)]
    data = [(f"r{i}", *[rnd.random() for _ in range(4)]) for i in range(30)] + [("same", 0.5, 0.5, 0.1, 0.2)]
    w, bias = [1.5, 1.5, 0.0, -2.0], -0.3
    base = [[a, a, c, d] for a, _, c, d in base]
    df = spark.createDataFrame(data, "id string, a double, b double, c double, d double")
    got = {}
    for r in metrics.coalition_shapley(df, "id", list("abcd"), w, bias, base).collect():
        got.setdefault(r["id"], {})[r["rasgo"]] = r["aporte"]
    score = lambda x: 1 / (1 + math.exp(-(sum(i * j for i, j in zip(w, x)) + bias)))
    mean = sum(map(score, base)) / len(base)
    for i, *x in data:
        assert abs(sum(got[i].values()) - (score(x) - mean)) < 1e-9 and abs(got[i]["c"]) < 1e-12
    assert abs(got["same"]["a"] - got["same"]["b"]) < 1e-12


def test_hops_against_the_projection(spark):
    rnd = random.Random(7)
    awards = sorted({(f"e{rnd.randrange(6)}", f"a{rnd.randrange(9)}") for _ in range(30)})
    actors = sorted({a for _, a in awards})
    x = {a: float(i) for i, a in enumerate(actors)}

    def step(values):
        out = {}
        for a in actors:
            near = [values[b] for e, b in awards if (e, a) in awards and b != a]
            out[a] = sum(near) / len(near) if near else 0.0
        return out

    one = step(x)
    two = step(one)
    got = graph.hops(spark.createDataFrame(awards, "entidad string, actor string"), spark.createDataFrame(list(x.items()), "actor string, v double"), ["v"])
    for r in got.collect():
        assert abs(r["v_1"] - one[r["actor"]]) < 1e-9 and abs(r["v_2"] - two[r["actor"]]) < 1e-9
