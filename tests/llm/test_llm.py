"""The training-data operators against brute force, round trips and stated cases."""

import itertools
import random
import unicodedata
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from caudal.llm import bpe, components, langid, mixing, names, queries, survivors

TOKENIZER = queries.TOKENIZER


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    got = df.collect()
    assert got and (name in {"p7_mix", "p7_mix_whole", "p8_found"} or len(set(map(repr, got))) == len(got))


# Groups of pairs


def union(pairs):
    leader = {}

    def find(v):
        while leader.setdefault(v, v) != v:
            leader[v] = leader[leader[v]]
            v = leader[v]
        return v

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        leader[y] = x
    return sorted((v, find(v)) for v in leader)


def test_groups_by_brute_force(spark):
    rnd = random.Random(5)
    pairs = [(f"N{rnd.randrange(400):03}", f"N{rnd.randrange(400):03}") for _ in range(330)] + [("HUB", f"N{i:03}") for i in range(0, 100, 3)]
    pairs = [(a, b) for a, b in pairs if a != b]
    links = spark.createDataFrame([tuple(sorted(p)) for p in pairs], "a string, b string").distinct()
    assert rows(components.group_labels(links)) == union(pairs)


def test_a_long_chain_takes_few_rounds(spark):
    pairs = [(f"{(i * 7919) % 3001:04}", f"{((i + 1) * 7919) % 3001:04}") for i in range(600)]
    links = spark.createDataFrame([tuple(sorted(p)) for p in pairs], "a string, b string")
    assert rows(components.group_labels(links, max_rounds=16)) == union(pairs)


def test_pairs_that_count(spark):
    data = [(" a ", "B", 0.95, "x"), ("b", "A", 0.1, "x"), ("B", "c", float("nan"), None), ("C", "d", None, None), ("e", "E", 1.0, None), (None, "f", 1.0, None), ("g", " H", 0.99, None), ("", "k", 1.0, None)]
    df = spark.createDataFrame(data, "l string, r string, score double, label string")
    known = spark.createDataFrame([("a",), ("z",), (None,), ("Z ",)], "id string")
    out = components.consolidate(df, "l", "r", "score", 0.95)
    assert rows(out) == [("A", "A"), ("B", "A"), ("G", "G"), ("H", "G")]
    assert rows(components.consolidate(df, "l", "r", "score", 0.95, known, "id")) == [("A", "A"), ("B", "A"), ("G", "G"), ("H", "G"), ("Z", "Z")]
    assert components.consolidate(df.limit(0), "l", "r", "score", 0.95).count() == 0


# Token ids


def test_ids_equal_the_library(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["", None, "a" * 5000, "ab" * 4000, "<|endoftext|> x", " \n\n\t x  ", "é́ 👷🏽‍♀️ ​", "\x00\x01", "naïve’s don't", "x" * 300 + " " + "x" * 300]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "k int, text string, ids string")
    got = {r["k"]: (r["ids"], r["n"]) for r in bpe.encode(df, "text", ["k"], TOKENIZER, "ids", "n").collect()}
    for i, x in enumerate(texts):
        want = t.encode(x, add_special_tokens=False).ids if x else []
        assert got[i] == (want, len(want))
    assert bpe.encode(df.limit(0), "text", ["k"], TOKENIZER).count() == 0


def test_chunks_and_cache_do_not_matter(spark, monkeypatch):
    texts = [f"palabra{i % 7} y {i} {'z' * i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    whole = rows(bpe.encode(df, "text", ["k"], TOKENIZER))
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 3)
    assert rows(bpe.encode(df, "text", ["k"], TOKENIZER)) == whole


# Mixing


def test_water_filling():
    sizes, weights, caps = {"a": 100, "b": 1000, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 1, "c": 1}
    take = mixing.water_fill(sizes, weights, caps, 1000)
    assert take["a"] == 200 and abs(take["b"] - 480) < 1e-9 and abs(take["c"] - 320) < 1e-9
    assert sum(mixing.water_fill(sizes, weights, caps, 1e9).values()) == 2200
    assert mixing.feasible_total(sizes, weights, caps) == 400
    assert mixing.water_fill({}, weights, caps, 10) == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_mix_meets_shares_and_caps(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["a", "a", "a", "a", "b", "c", None, "other"]), rnd.choice([0, 5, 20, 100])) for i in range(6000)] + [(None, "a", 10), (7, "a", 10), (7, "a", 10)]
    sized = spark.createDataFrame(docs, "doc long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.3, 2), ("missing", 0.1, 3), ("none", None, None)], "source string, peso double, max_repeticiones int")
    plan = mixing.plan(sized, targets, None)
    mixed = mixing.mix(sized, "doc", plan)
    share = {r["source"]: (r["tokens_objetivo"], r["tokens_mezcla"], r["cuota"]) for r in mixing.shares(mixed, plan).collect()}
    for s in "abc":
        assert abs(share[s][0] - share[s][1]) <= 100
    assert abs(share["a"][2] - 0.2) < 0.01 and share["missing"][1] == 0
    caps = {"a": 1, "b": 4, "c": 2}
    assert all(1 <= r["repeticiones"] <= caps[r["source"]] for r in mixed.collect())
    assert rows(mixed) == rows(mixing.mix(sized.repartition(7), "doc", plan))
    empty = mixing.plan(sized.limit(0), targets, None)
    assert mixing.mix(sized.limit(0), "doc", empty).count() == 0 and mixing.shares(mixing.mix(sized.limit(0), "doc", empty), empty).count() == 5


# Languages

PHRASES = {
    "es": ["el contratista debe entregar los informes cada mes", "la obra fue suspendida por las lluvias de abril", "se recibieron varias ofertas para este proceso"],
    "en": ["the contractor shall deliver the reports every month", "the works were stopped because of the april rains", "several bids were received for this tender"],
    "pt": ["a contratada deve entregar os relatórios todos os meses", "a obra ficou parada por causa das chuvas de abril", "foram recebidas várias propostas para este processo"],
    "fr": ["le titulaire doit remettre les rapports chaque mois", "le chantier est arrêté à cause des pluies du printemps", "nous avons reçu plusieurs offres pour ce marché"],
    "it": ["l'impresa deve consegnare le relazioni ogni mese", "il cantiere è fermo per le piogge di aprile", "sono arrivate diverse offerte per questa gara"],
}


def documents(seed=4, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(langid.LANGS)
        text = ". ".join(rnd.choice(PHRASES[lang]).capitalize() for _ in range(rnd.randrange(1, 4))) + "."
        label = lang if rnd.random() < 0.8 else rnd.choice([None, "xx", rnd.choice(langid.LANGS), f"{lang.upper()}-XX"])
        out.append((i, text.upper() if rnd.random() < 0.1 else text, label, f"h{i % 9}" if i % 5 else None, rnd.choice(["s", "t", None]), lang))
    return out


def test_languages(spark):
    docs = documents()
    mixed = [(1000, PHRASES["es"][0].capitalize() + ". " + PHRASES["en"][1].capitalize() + ". " + PHRASES["es"][1].capitalize() + ".", "en", "h1", "s", "es")]
    odd = [(2000, None, "es", None, None, None), (2001, "", None, None, None, None), (2002, "--- 123 ---", None, "h1", "s", None), (2003, "CO1.BDOS.77", None, "h1", "s", None), (2004, (PHRASES["it"][0] + ". ") * 3000, "it", "h1", "s", "it")]
    df = spark.createDataFrame([d[:5] for d in docs + mixed + odd], "doc long, text string, lang string, pasajes string, j string")
    got = {r["doc"]: r for r in langid.identify(df, "doc", "text", "lang", "pasajes", "j").collect()}
    assert all(got[d[0]]["lang"] == d[5] for d in docs + mixed) and got[2004]["lang"] == "it" and len(got[2004]["pasajes"]) >= 3000
    assert all(0 < r["confianza"] <= 1 + 1e-9 for r in got.values())
    cases = rows(langid.label_cases(langid.identify(df, "doc", "text", "lang", "pasajes", "j"), "doc"))
    want = [(d[0], "etiqueta", d[5]) for d in docs if d[2] is None or d[2].lower()[:2] != d[5]] + [(1000, "etiqueta", "es"), (1000, "mezcla", "es"), (1000, "mezcla", "en")]
    assert cases == sorted(want, key=repr)
    assert langid.identify(df.limit(0), "doc", "text", "lang", "pasajes", "j").count() == 0


def test_markup_declares_a_language(spark):
    """Texts without words have no evidence of their own; the language of their markup decides."""
    docs = documents(7, 300)
    marked = [(d[0], f'<p lang="{d[5]}">{d[1]}</p>', d[2], d[3], d[4]) for d in docs]
    bare = [(5000 + i, f"<html><body xml:lang='{l}' class='{'x' * 300}'>123 456</body></html>", None, None, None) for i, l in enumerate(langid.LANGS)]
    df = spark.createDataFrame(marked + bare, "doc long, text string, lang string, host string, grp string")
    got = {r["doc"]: r for r in langid.identify(df, "doc", "text", "lang", "host", "grp").collect()}
    assert [got[5000 + i]["lang"] for i in range(5)] == langid.LANGS and not got[5000]["pasajes"]


def test_labels(spark):
    data = [(" es", "es"), ("Español", "es"), ("es_419", "es"), ("pt-BR", "pt"), ("Inglés", "en"), ("français", "fr"), ("ita", "it"), ("xx", None), ("", None), (None, None), ("No Definido", None), ("?", None)]
    df = spark.createDataFrame(data, "l string, w string")
    assert all(r[0] == r[1] for r in df.select(langid.label_language(F.col("l")), "w").collect())


def test_passages_keep_their_place():
    text = "<p>Hola mundo.</p> Ver https://x.example/a.b ahora (no. 3). Fin"
    clean = langid.clean(text)
    assert len(clean) == len(text) and "https" not in clean
    assert [clean[a:b].strip() for a, b in langid.passages(clean)][-1] == "Fin"


# Names


def test_words_and_levels():
    assert names.words("JOSÃ‰ de la PEÃ‘A", names.PEOPLE) == ["JOSE", "PENA"]
    assert names.words("ING. JOSE  P3REZ, G0mez", names.PEOPLE) == ["JOSE", "PEREZ", "GOMEZ"]
    assert names.words("E.S.E. Hospital San Zenón", names.ORGANISATIONS) == ["HOSPITAL", "SAN", "ZENON"]
    assert names.words(None, names.PEOPLE) == [] == names.words("...", names.PEOPLE)
    assert names.level("Pérez,  Ana.") == "PEREZANA"


def test_banding_reaches_its_recall():
    for s, recall, most in [(0.3, 0.95, 128), (0.5, 0.95, 256), (0.55, 0.95, 512), (0.8, 0.99, 64)]:
        r, b = names.banding(s, recall, most)
        assert r * b <= most and names.collision(s, r, b) >= recall


def spelled(seed=8, people=150):
    """Records ``(id, name, document)`` and the person of each."""
    rnd = random.Random(seed)
    syllables = ["BA", "RE", "TI", "LON", "MU", "CAR", "DES", "NI", "GO", "PAR", "SU", "VEL"]
    surname = lambda: "".join(rnd.choice(syllables) for _ in range(3))
    given = ["JUAN", "ANA", "LUIS", "ROSA", "CARLOS", "MARTA"]
    out, who = [], {}
    for p in range(people):
        words = [rnd.choice(given), rnd.choice(given), surname(), surname()]
        document = str(1_000_000_000 + rnd.randrange(10**8))
        for k in range(rnd.randrange(1, 6)):
            w = list(words)
            kind = rnd.randrange(6)
            if kind == 0:
                i = rnd.randrange(2, 4)
                j = rnd.randrange(1, len(w[i]) - 1)
                w[i] = w[i][:j] + w[i][j + 1 :]
            elif kind == 1:
                w = w[2:] + w[:2]
            elif kind == 2:
                w[1] = w[1][0] + "."
            text = " ".join(w).title() if kind == 3 else " ".join(w)
            key = f"{p:03}-{k}"
            out.append((key, text, None if kind == 4 and k else document))
            who[key] = p
    return out, who


def test_variants_found(spark):
    data, who = spelled()
    df = spark.createDataFrame([*data, data[0], ("x1", None, "123"), ("x2", "No Definido", "123"), ("x3", " ", None)], "id string, label string, node string")
    linked = names.link_names(df, "id", "label", names.PEOPLE, None, names.digits(F.col("node")))
    got = {tuple(r) for r in names.variant_pairs(linked).collect()}
    text = {k: names.level(t) for k, t, _ in data}
    want = {(a, b) for a, b in itertools.combinations(sorted(who), 2) if who[a] == who[b] and text[a] != text[b]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)
    assert names.link_names(df.limit(0), "id", "label", names.PEOPLE).count() == 0


def test_candidates_against_all_pairs(spark):
    """The bands find the similar pairs that a comparison of all pairs finds, with at least the recall asked for; large buckets lose none."""
    from caudal.session import Stages

    data, _ = spelled(9, 120)
    words = sorted({" ".join(sorted(names.words(t, names.PEOPLE))) for _, t, _ in data})
    nodes = names.with_frequencies(spark.createDataFrame([(i, w, "") for i, w in enumerate(words)], "node long, palabras string, lugar string"))
    nodes = Stages(spark, "t").cut(nodes, "nodes")
    found = {tuple(r) for r in names.candidates(nodes, Stages(spark, "t"), 0.5).collect()}
    each = {r["node"]: set(names.features(r["palabras"].split(" ")).tolist()) for r in nodes.collect()}
    similar = {(a, b) for a, b in itertools.combinations(sorted(each), 2) if len(each[a] & each[b]) >= 0.5 * len(each[a] | each[b])}
    assert len(found & similar) >= 0.95 * len(similar) > 20


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_blocks_lose_no_pair_of_a_bucket(spark, block):
    from caudal.session import Stages

    rnd = random.Random(3)
    members = [(n, b) for b, size in enumerate([1, 2, 3, 20, 45]) for n in rnd.sample(range(100), size)]
    got = names.bucket_pairs(spark.createDataFrame(members, "node long, bucket long"), Stages(spark, "t"), "t", block)
    want = [(a, b) for k in range(5) for a, b in itertools.combinations(sorted(n for n, x in members if x == k), 2)]
    assert rows(got) == sorted(want, key=repr)
    assert names.bucket_pairs(spark.createDataFrame(members, "node long, bucket long").limit(0), Stages(spark, "t"), "t", block).count() == 0


@pytest.mark.parametrize("kind", ["int", "long"])
def test_rounds_of_candidates_are_bounded_and_whole(spark, monkeypatch, kind):
    from caudal.session import Stages

    rng = random.Random(5)
    words = ["".join(rng.choice("ABCDEL") for _ in range(4)) for _ in range(12)]
    texts = sorted({" ".join(sorted(rng.sample(words, 3))) for _ in range(120)})
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, palabras string").select(F.col("node").cast(kind), "palabras", F.lit("").alias("lugar"))
    idents = spark.createDataFrame([(i, str(i % 7)) for i in range(20)], "node long, ident string").select(F.col("node").cast(kind), "ident")
    stages = Stages(spark, "t")
    whole = rows(names.candidates(nodes, stages, 0.5, idents))
    assert len(list(names.candidate_rounds(nodes, stages, 0.5, idents))) == 1
    monkeypatch.setattr(names, "ROUND", 1500)
    each = names.written_cells(nodes, stages, 0.5, None, len(texts))
    cells = [df.agg(F.sum(F.size("nodes"))).first()[0] or 0 for df in each]
    assert len(cells) > 2 and 0 < max(cells)
    rounds = [rows(df) for df in names.candidate_rounds(nodes, stages, 0.5, idents)]
    assert len(rounds) > 2 and max(map(len, rounds)) < len(whole)
    assert sorted(itertools.chain(*rounds), key=repr) == whole


def test_linking_leaves_no_intermediate_files(spark):
    import time
    from pathlib import Path

    from caudal.session import shared_dir

    root = Path(shared_dir(spark).removeprefix("file://"))
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, held = set(root.iterdir()), shuffled()
    df = spark.createDataFrame([(f"k{i}", f"ANA PEREZ{'' if i % 2 else 'S'}", str(1000000 + i // 2)) for i in range(40)], "id string, name string, doc string")
    linked = names.link_names(df, "id", "name", names.PEOPLE, None, names.digits(F.col("doc")))
    (made,) = set(root.iterdir()) - before
    assert [p.name.split("-")[0] for p in made.iterdir()] == ["grouped"]
    assert linked.count() == 40
    end = time.time() + 20
    while shuffled() - held and time.time() < end:
        time.sleep(0.5)
    assert len(shuffled() - held) <= 4  # of the count itself, and of reads that were no writes


def test_numbers_are_dense(spark):
    from caudal.session import Stages

    nodes = spark.range(1000, 1500, 1, 7).withColumnRenamed("id", "node")
    out = names.numbered(nodes, Stages(spark, "t"))
    assert rows(out.select("number")) == sorted([(i,) for i in range(500)], key=repr) and out.select("node").distinct().count() == 500
    assert names.numbered(nodes.limit(0), Stages(spark, "t")).count() == 0


def test_equal_identifiers_are_candidates(spark):
    from caudal.session import Stages

    nodes = spark.createDataFrame([(1, "ANA RUIZ", ""), (2, "BETO SOLO", "")], "node long, palabras string, lugar string")
    idents = spark.createDataFrame([(1, "1000000001"), (2, "1000000001")], "node long, ident string")
    assert rows(names.candidates(nodes, Stages(spark, "t"), 0.5, idents)) == [(1, 2)]


@pytest.mark.parametrize("a, b", [("JUAN CARLOS GARCIA LOPEZ", "JAUN CARLOS GARCIA LOPEZ"), ("JUAN CARLOS GARCIA LOPEZ", "JUAN CARLOS GACRIA LOPEZ"), ("JUAN CARLOS GARCIA LOPEZ", "JUAN GARCIA LOPEZ")])
def test_common_words_and_their_misspellings_collide(a, b):
    x, y = (set(names.features(t.split()).tolist()) for t in (a, b))
    assert names.collision(len(x & y) / len(x | y), *names.banding(names.PEOPLE.similar, names.RECALL, names.MOST_HASHES)) >= names.RECALL


def test_short_forms_are_learnt_from_identifiers(spark):
    data = [("CHEPE RUIZ", "1"), ("JOSE RUIZ", "1"), ("JOSE RUIZ", "1"), ("CHEPE LARA", "2"), ("JOSE LARA", "2"), ("JOSE PAZ", "3"), ("JUAN PAZ", "3"), ("JOSE SOL", None), ("CHEPE SOL", None)]
    read = spark.createDataFrame([(" ".join(sorted(n.split())), i) for n, i in data], "palabras string, ident string")
    forms = names.short_forms(read)
    assert rows(forms) == [("CHEPE", "JOSE")]
    from caudal.session import Stages

    out = names.written_out(read, forms, Stages(spark, "t")).where("ident is null")
    assert rows(out.select("palabras")) == [("JOSE SOL",), ("JOSE SOL",)]
    assert names.short_forms(read.limit(0)).count() == 0


def test_abbreviations_follow_rules():
    assert names.abbreviates("MPAL", "MUNICIPAL") and names.abbreviates("HACIENDA", "HDA") and not names.abbreviates("SALUD", "SALIDA")
    assert names.spelt_by("INVIDUR", ["DESARROLLO", "INSTITUTO", "URBANO", "VIVIENDA"]) is not None
    assert names.spelt_by("UT", ["TECNOLOGICA", "UNIVERSIDAD"]) is not None and names.spelt_by("UT", ["UNIVERSIDAD"]) is None
    assert names.spelt_by("XY", []) is None
    one = lambda a, b: names.monge_elkan(a.split(), b.split(), [1.0] * len(a.split()), [1.0] * len(b.split()), frozenset(["RIO"]), names.abbreviated_similarity, True)
    assert min(one("IDR RIO", "DEPORTE INSTITUTO RECREACION RIO")) > 0.9
    assert min(one("CONTR MPAL RIO", "CONTRALORIA MUNICIPAL RIO")) > 0.9
    assert min(one("SEP HOSPITAL RIO", "EDUCACION PUERTA SECRETARIA RIO")) < 0.4


def test_namesakes_stay_apart(spark):
    data = [("a1", "ANA RUIZ LOPERA", "1000000001"), ("a2", "Ana  Ruis Lopera", "1000000001"), ("b1", "ANA RUIZ LOPERA", "1099887766"), ("b2", "RUIZ LOPERA ANA", "1099887766"), ("c", "ANA RUIZ LOPERA", None)]
    df = spark.createDataFrame(data, "id string, name string, doc string")
    linked = names.link_names(df, "id", "name", names.PEOPLE, None, names.digits(F.col("doc")))
    assert rows(names.variant_pairs(linked)) == [("a1", "a2"), ("b1", "b2")]


def test_star_clusters_are_greedy(spark):
    from caudal.session import Stages

    rnd = random.Random(6)
    edges = {}
    for _ in range(120):
        a, b = sorted(rnd.sample(range(60), 2))
        edges[a, b] = round(rnd.random(), 3)
    ids = sorted({v for e in edges for v in e})
    mass = {v: rnd.randrange(1, 4) for v in ids}
    near = {v: {} for v in ids}
    for (a, b), s in edges.items():
        near[a][b] = near[b][a] = s
    rank = {v: (round(mass[v] + sum(s * mass[u] for u, s in near[v].items()), 6), v) for v in ids}
    got = dict(
        tuple(r)
        for r in names.star_clusters(
            spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "p long, q long, score double"), spark.createDataFrame(list(mass.items()), "id long, n long"), Stages(spark, "t")
        ).collect()
    )
    assert sorted(got) == ids
    centers = {v for v in ids if got[v] == v}
    greedy, taken = set(), set()
    for v in sorted(ids, key=rank.get, reverse=True):
        if v not in taken:
            greedy.add(v)
            taken |= {v, *near[v]}
    assert centers == greedy
    assert all(got[v] in near[v] for v in ids if v not in centers)


def test_buyers_of_equal_name_in_other_departments(spark):
    t = datetime(2025, 1, 1)
    base = [("1", "ALCALDÍA MUNICIPAL DE RIO", "Rio", "Norte", "801.195.218-9"), ("2", "ALC. MPAL. RIO", "RIO", None, "801195218"), ("3", "Alcaldía Municipal de Rio", "Rio", "Sur", None), ("4", "CONCEJO MUNICIPAL DE RIO", "Rio", "Norte", "801195218")]
    df = spark.createDataFrame([(c, n, m, d, x, t) for c, n, m, d, x in base], "codigo_entidad string, nombre_entidad string, ciudad string, departamento string, nit_entidad string, grupo timestamp")
    assert rows(names.variant_pairs(names.link_buyers(df))) == [("1", "2")]


# Best record


def test_nit(spark):
    cases = [("801.195.218", "801195218"), ("800000000", "800000000"), ("111111111", None), ("123456789", None), ("12345", None), (None, None), ("", None), ("NIT 802.654.897-5", "802654897"), ("802654897-4", None), ("1111111111", None)]
    df = spark.createDataFrame(cases, "c string, w string")
    assert [r[0] for r in df.select(survivors.usable_nit(F.col("c")), "w").collect()] == [w for _, w in cases]


def test_fusion_discounts_copies(spark):
    """Three sources copy one bad one; two honest sources outvote them once the copies are found."""
    rnd = random.Random(1)
    claims, truth = [], {}
    for g in range(300):
        truth[g] = f"t{g}"
        bad = f"f{g}" if rnd.random() < 0.6 else truth[g]
        honest = lambda: truth[g] if rnd.random() < 0.9 else f"x{rnd.randrange(9)}"
        for s, v in [("good1", honest()), ("good2", honest()), ("good3", honest()), ("bad", bad), ("copy1", bad), ("copy2", bad), ("copy3", bad)]:
            claims.append((g, "field", v, s, datetime(2025, 1, 1)))
    df = spark.createDataFrame([*claims, claims[0], (0, "field", None, "good1", None), (0, "field", "t0", None, None)], "grupo long, campo string, valor string, fuente string, fecha timestamp")
    out = survivors.fuse(df)
    best = {r["grupo"]: r["field"] for r in survivors.most_probable(out.values, "field").collect()}
    right = sum(best[g] == truth[g] for g in truth)
    votes = sum(Counter(c[2] for c in claims if c[0] == g).most_common(1)[0][0] == truth[g] for g in truth)
    assert right >= 0.95 * len(truth) > votes
    assert out.dependence["bad", "copy1"] > 0.9 > 0.1 > out.dependence["good1", "good2"]
    assert out.accuracy["good1"] > 0.8 > out.accuracy["bad"]
    p = out.values.groupBy("grupo").agg(F.sum("confianza").alias("s")).agg(F.max("s")).first()[0]
    assert p <= 1 + 1e-9
    assert survivors.fuse(df.limit(0)).values.count() == 0


def test_many_votes_still_tell_values_apart(spark):
    """Votes far beyond the range of an exponential: one source more still makes a difference; a declared order outweighs all."""
    values = [(1, "field", "a", list(range(200)), 0.0), (1, "field", "b", list(range(200, 401)), 0.0), (1, "other", "a", list(range(200)), 0.0), (1, "other", "b", list(range(200, 401)), -survivors.DECLARED)]
    df = spark.createDataFrame(values, "grupo long, campo string, valor string, fs array<int>, previo double")
    p = {(r["campo"], r["valor"]): r["confianza"] for r in survivors._judged(df, np.full(401, 0.8), {}).collect()}
    assert abs(p["field", "b"] / p["field", "a"] - 40) < 0.01 and abs(p["field", "a"] + p["field", "b"] - 1) < 1e-6
    assert p["other", "a"] > 0.999 and p["other", "b"] == 0


def test_copied_numbers_lose(spark):
    """Whole records: four kinds of writing hand on one wrong NIT; the three that don't decide what comes out."""
    rnd, rows_, groups, truth = random.Random(4), [], [], {}
    nit = lambda: f"8{rnd.randrange(10**7, 10**8)}"
    styles = [("Uno Dos", "{}"), ("uno dos", "{}"), ("UNO DOS", "{0}-"), ("UNO DOS", "{0}."), ("uno dos", "{0}."), ("Uno Dos", "{0}."), ("Uno Dos", "{0}-")]
    for g in range(200):
        truth[g], wrong = nit(), nit()
        handed_on = wrong if rnd.random() < 0.6 else truth[g]
        for k, (name, form) in enumerate(styles):
            value = handed_on if k > 2 else truth[g] if rnd.random() < 0.9 else nit()
            rows_.append((f"{g:03}-{k}", form.format(value), name, None, None, k, datetime(2025, 1, 1 + k)))
            groups.append((f"{g:03}-{k}", "N", g))
    df = spark.createDataFrame(rows_, "codigo_entidad string, nit_entidad string, nombre_entidad string, departamento string, orden_entidad string, n_contratos_hist long, fecha_actualizacion timestamp")
    best = {int(r["codigo_entidad"][:3]): r["nit_entidad"] for r in survivors.surviving_buyers(df, spark.createDataFrame(groups, "clave string, nivel string, grupo long")).collect()}
    assert sum(best[g] == truth[g] for g in truth) >= 0.97 * len(truth)


@pytest.mark.parametrize("build", [survivors.chosen_buyers, survivors.surviving_buyers])
def test_the_posterior_decides(spark, monkeypatch, build):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([(str(i), f"8011952{i % 3}8", "n", None, None, i, datetime(2025, 1, 20 - i), t) for i in range(1, 9)], "codigo_entidad string, nit_entidad string, nombre_entidad string, departamento string, orden_entidad string, n_contratos_hist long, fecha_actualizacion timestamp, fecha_carga timestamp")
    groups = spark.createDataFrame([(str(i), "N", i % 2) for i in range(1, 9)], "clave string, nivel string, grupo long")
    whole, judged = rows(build(df, groups)), survivors._judged
    flat = lambda *a: judged(*a).withColumn("voto", F.lit(0.0)).withColumn("confianza", F.lit(0.5))
    monkeypatch.setattr(survivors, "_judged", flat)
    assert rows(build(df, groups)) != whole


def test_chosen_record(spark):
    t = lambda d: datetime(2025, 1, d)
    data = [("1", "801195218", 5, t(1)), ("1", "801195218", 2, t(20)), ("2", "802.654.897-5", None, t(21)), ("3", "basura", 5, t(3)), ("3", "800000001", 0, None), ("9", "800000000", 7, t(1))]
    df = spark.createDataFrame([(c, x, "n", None, None, n, d, d, "clash") for c, x, n, d in data], "codigo_entidad string, nit_entidad string, nombre_entidad string, departamento string, orden_entidad string, n_contratos_hist long, fecha_actualizacion timestamp, fecha_carga timestamp, grupo string")
    groups = spark.createDataFrame([("1", "N", 1), ("2", "N", 1), ("3", "N", 1), ("9", "N", 2)], "clave string, nivel string, grupo long")
    assert rows(survivors.chosen_buyers(df, groups)) == [("3", "802654897", 5)]
    assert survivors.surviving_buyers(df, groups).first()["codigo_entidad"] == "3"
    assert survivors.chosen_buyers(df.limit(0), groups).count() == 0


def test_levels_agree_with_the_standard(spark):
    assert names.level("ÑANDÚ (x)") == "".join(c for c in unicodedata.normalize("NFKD", "ñandú x").upper() if c.isalnum())
    assert np.array_equal(names.gram_codes("ANA"), names.gram_codes("ANA"))


def test_name_similarity():
    one = lambda a, b: names.monge_elkan(a.split(), b.split(), [1.0] * len(a.split()), [1.0] * len(b.split()))
    assert one("ANA RUIZ", "RUIZ ANA") == (1.0, 1.0)
    assert one("LUISJAIRO MUGALNA", "LUIS JAIRO MUGALNA") == (1.0, 1.0)
    assert one("ANA RUIZ", "ANA RUIZ LOPERA") == (1.0, 2 / 3)
    assert one("A RUIZ", "ANA RUIZ")[1] > 0.9
    assert one("ZECRETARIA", "SECRETARIA")[0] > 0.9
    assert one("SALUD", "EDUCACION") == (0.0, 0.0)
    assert names.monge_elkan([], ["X"], [], [1.0]) == (0.0, 0.0)


def test_scores_of_words():
    model = langid.TextModel({"casa": [9, 0, 1, 0, 0], "house": [0, 9, 0, 0, 0]})
    s = langid.Scores(model)
    one = s.of(["casa house casa", "", "casita", "ñññ", "house"])
    assert np.allclose(one[0], 2 * model.words["casa"].astype(float) + model.words["house"]) and not one[1].any() and not one[3].any()
    assert one[2].argmax() == 0 and np.allclose(one[4], model.words["house"])
    assert s.of([]).shape == (0, len(langid.LANGS))


def test_ranges_are_narrowed(spark, monkeypatch):
    """With tiny ranges the choice takes several rounds and stays within a document of its goal; copies are not told apart."""
    rnd = random.Random(9)
    docs = [(i, "a", rnd.choice([1, 5, 20])) for i in range(3000)] + [(None, "a", 5)] * 400 + [(7777, "b", 10)] * 50
    sized = spark.createDataFrame(docs, "doc long, source string, n_tokens int")
    plan = spark.createDataFrame([("a", 1, 9000.0), ("b", 0, 123.0), ("c", 0, 5.0), ("d", 2, 0.0)], "source string, enteras int, resto double")
    monkeypatch.setattr(mixing, "PARTS", 4)
    monkeypatch.setattr(mixing, "FEW", 2)
    mixed = mixing.mix(sized, "doc", plan)
    got = {r["source"]: (r["n"], r["t"], r["hi"]) for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_tokens") * F.col("repeticiones")).alias("t"), F.max("repeticiones").alias("hi")).collect()}
    size = sum(d[2] for d in docs if d[1] == "a")
    assert got["a"][0] == 3400 and abs(got["a"][1] - size - 9000) <= 20 and got["a"][2] == 2
    assert got["b"] == (12, 120, 1) and set(got) == {"a", "b"}
    monkeypatch.setattr(mixing, "PARTS", 1024)
    monkeypatch.setattr(mixing, "FEW", 512)
    assert abs(mixing.mix(sized, "doc", plan).where("source = 'a'").agg(F.sum(F.col("n_tokens") * F.col("repeticiones"))).first()[0] - size - 9000) <= 20
