"""Variant spellings of names typed by people, linked to the entity they mean."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.session import Stages


@dataclass(frozen=True)
class Naming:
    """How names of one kind are read, and what makes two of them the same."""

    #: Written form of a word -> the words it stands for.
    stands_for: dict[str, str] = field(default_factory=dict)
    #: Words that tell nothing, such as articles, titles and legal forms.
    noise: frozenset[str] = frozenset()
    #: Least Monge-Elkan similarity in the better and in the worse direction; with an agreeing identifier; without.
    agreeing: tuple[float, float] = (0.72, 0.35)
    alone: tuple[float, float] = (0.90, 0.60)
    #: Jaccard similarity of padded grams at which the banding reaches its recall.
    similar: float = 0.55
    #: Words may be abbreviated by leaving letters out, and several words by their first letters.
    abbreviated: bool = False


#: Names of public bodies. ``stands_for`` has the usual other name of a city hall; abbreviations follow from rules.
ORGANISATIONS = Naming(
    stands_for={"MUNICIPIO": "ALCALDIA MUNICIPAL", "MPIO": "ALCALDIA MUNICIPAL"},
    noise=frozenset("DE DEL LA LAS LOS EL EN Y E S A SA H ESE SOCIAL ESTADO OF OFICIAL OFICIALES SEDE PRINCIPAL NIVEL CENTRAL COLOMBIA LTDA SAS".split()),
    alone=(0.85, 0.40),
    similar=0.25,
    abbreviated=True,
)
#: Names of people and their usual titles; short forms of given names are learnt (``short_forms``).
PEOPLE = Naming(
    noise=frozenset("DE DEL LA LAS LOS Y SR SRA ING ABG LIC DR DRA DON DONA DOCTOR DOCTORA INGENIERO ABOGADO".split()),
)
#: Placeholders in place of a name.
NO_NAME = frozenset("NODEFINIDO NOPROVISTO NOAPLICA NOADJUDICADO SINDESCRIPCION NOINFORMADO NA NINGUNO NULL".split())
#: Texts that are no identifier, as digits.
NO_IDENTIFIER = ["123456789", "1234567890", "12345678", "987654321"]

GRAM = 3
#: Names become candidates when they agree in AGREE bands or more. Two names of the Jaccard similarity that their naming
#: states do so with probability RECALL or more; a signature has up to MOST_HASHES hashes.
AGREE, RECALL, MOST_HASHES = 2, 0.95, 512
#: Least similarity in the better and in the worse direction of a pair of names that is kept.
LEAST = (0.7, 0.3)
#: Buckets above this size are cut into blocks of about this size, and every two blocks compared.
BLOCK = 256
#: A round shuffles about this many band rows or pairs, or PER_NAME for each name where that is more, so what lies on
#: disk at a time grows with the names, while the number of rounds grows with the pairs.
ROUND, PER_NAME = 3_000_000, 8


def repair(text: str) -> str:
    """Undoes UTF-8 text that was read as Western Latin."""
    if "Ã" not in text and "Â" not in text:
        return text
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return text
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return text


def level(text: str | None) -> str:
    """Without case, accents, punctuation and blanks."""
    plain = unicodedata.normalize("NFKD", text or "").upper()
    return "".join(c for c in plain if c.isalnum())


_DIGITS = str.maketrans("01345", "OIEAS")


def words(text: str | None, naming: Naming) -> list[str]:
    """The words of a name as it is meant: repaired, levelled, written out, without noise and repetition."""
    plain = unicodedata.normalize("NFD", repair(text or "").upper())
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    plain = re.sub(r"\(A\)", "", plain)
    plain = re.sub(r"(?<![^\W_]{2})([^\W_])\.(?=[^\W_](?:\.|\b))", r"\1", plain)
    out: dict[str, None] = {}
    for w in re.findall(r"[^\W_]+", plain):
        if any(c.isalpha() for c in w):
            w = w.translate(_DIGITS)
        for part in naming.stands_for.get(w, w).split():
            if part not in naming.noise:
                out[part] = None
    return list(out)


def collision(similarity: float, rows: int, bands: int, agree: int = AGREE) -> float:
    """Probability that two sets of this Jaccard similarity agree in ``agree`` or more bands."""
    p = similarity**rows
    return 1 - sum(math.comb(bands, k) * p**k * (1 - p) ** (bands - k) for k in range(agree))


def banding(similarity: float, recall: float, most: int) -> tuple[int, int]:
    """The most rows a band, and the fewest such bands, with which the collision curve reaches ``recall`` at ``similarity``."""
    for rows in range(16, 0, -1):
        for bands in range(AGREE, most // rows + 1):
            if collision(similarity, rows, bands) >= recall:
                return rows, bands
    raise ValueError(f"no banding of {most} hashes reaches {recall} at {similarity}")


def grams(word: str) -> list[str]:
    p = f"^{word}$"
    return [p[i : i + GRAM] for i in range(max(1, len(p) - GRAM + 1))]


def word_similarity(a: str, b: str) -> float:
    """Jaro-Winkler (0 where far too few letters agree); an initial or a short form agrees with the word it begins."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.85 if b[0] == a else 0.0
    if len(a) >= 3 and b.startswith(a):
        return 0.92
    if a[0] != b[0] and len(set(a) & set(b)) * 2 < len(set(a)):
        return 0.0
    reach = max(len(b) // 2 - 1, 0)
    used, same = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                same.append(c)
                break
    m = len(same)
    if not m:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(same, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def abbreviates(a: str, b: str) -> bool:
    """Whether the shorter word is the longer one with letters left out: it keeps the first letter and the order of the rest."""
    if len(a) > len(b):
        a, b = b, a
    if not 3 <= len(a) <= 5 or a[0] != b[0] or len(b) < len(a) + 2:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def abbreviated_similarity(a: str, b: str) -> float:
    s = word_similarity(a, b)
    return 0.92 if s < 0.92 and abbreviates(a, b) else s


def spelt_by(word: str, parts: list[str], most: int = 3) -> list[int] | None:
    """Which two or more of ``parts``, in any order, give ``word`` when 1 to ``most`` of their first letters are run together."""

    def run(at: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        if at == len(word):
            return used if len(used) > 1 else None
        for j, p in enumerate(parts):
            if j not in used:
                for n in range(1, most + 1):
                    if word[at : at + n] != p[:n] or at + n > len(word):
                        break
                    if got := run(at + n, (*used, j)):
                        return got
        return None

    return list(got) if 2 <= len(word) <= 8 and (got := run(0, ())) else None


def monge_elkan(
    a: list[str],
    b: list[str],
    wa: list[float],
    wb: list[float],
    light: frozenset[str] = frozenset(),
    similar: Callable[[str, str], float] = word_similarity,
    acronyms: bool = False,
) -> tuple[float, float]:
    """Weighted mean, over the words of one name, of the best similarity in the other: better and worse direction.

    Similarities under 0.8 count as none, as do those of words that differ in both their first and last letter. A word
    that runs two words of the other name together agrees with both; with ``acronyms`` one of first letters agrees with
    all the words that they begin, if it is all that is left of its name or both names have it. Words in ``light`` (such as those of the place that both names share) weigh little.
    """
    best_a = [1.0 if x in b else 0.0 for x in a]
    best_b = [1.0 if y in a else 0.0 for y in b]
    open_a = [i for i, s in enumerate(best_a) if not s]
    open_b = [j for j, s in enumerate(best_b) if not s]
    if open_a and open_b:
        for i in open_a:
            x = a[i]
            for j in open_b:
                y = b[j]
                if x[0] == y[0] or x[-1] == y[-1]:
                    s = similar(x, y)
                    if s >= 0.8:
                        if s > best_a[i]:
                            best_a[i] = s
                        if s > best_b[j]:
                            best_b[j] = s
        for one, two, own, far, left, other in ((a, b, best_a, best_b, open_a, open_b), (b, a, best_b, best_a, open_b, open_a)):
            if len(other) > 1:
                for i in left:
                    x = one[i]
                    if own[i] < 0.93 and len(x) >= 7:
                        for j in other:
                            for k in other:
                                if j != k and abs(len(two[j]) + len(two[k]) - len(x)) <= 1 and (s := similar(x, two[j] + two[k])) >= 0.93:
                                    own[i], far[j], far[k] = max(own[i], s), max(far[j], s), max(far[k], s)

    if acronyms:
        for one, two, own, far in ((a, b, best_a, best_b), (b, a, best_b, best_a)):
            lone = sum(s < 0.8 and w not in light for w, s in zip(one, own)) == 1
            for i, x in enumerate(one):
                other = [j for j, s in enumerate(far) if s < 0.8 and two[j] not in light]
                if len(other) > 1 and x not in light and (own[i] == 1.0 or lone and own[i] < 0.8) and (got := spelt_by(x, [two[j] for j in other])):
                    own[i] = max(own[i], 0.92)
                    for k in got:
                        far[other[k]] = 0.92

    def mean(words: list[str], weights: list[float], best: list[float]) -> float:
        total = got = 0.0
        for x, w, s in zip(words, weights, best):
            if x in light:
                w = 0.1
            total += w
            got += w * s
        return got / total if total else 0.0

    x, y = mean(a, wa, best_a), mean(b, wb, best_b)
    return (x, y) if x >= y else (y, x)


def read_names(df: DataFrame, name: str, naming: Naming) -> DataFrame:
    """All columns with ``nivel`` (levelled name) and ``palabras`` (its words, in order); placeholders give null."""
    fields = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, meant = [], []
            for t in batch.column(len(fields)).to_pylist():
                flat = level(t)
                w = words(t, naming) if flat and flat not in NO_NAME else []
                plain.append(flat if w else None)
                meant.append(" ".join(sorted(w)) if w else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(plain, pa.string()), pa.array(meant, pa.string())], names=[*fields, "nivel", "palabras"]
            )

    schema = df.schema.simpleString()[len("struct<") : -1]
    return df.select("*", df[name].alias("__name")).mapInArrow(run, f"{schema},nivel string,palabras string")


def short_forms(read: DataFrame) -> DataFrame:
    """``(corta, larga)``: other forms of words, such as nicknames, learnt from names with an equal identifier.

    Each name of an identifier is held to the most frequent one of that identifier; where one word stands in place of
    another, their identifier is a vote for the rarer word to be a form of the more frequent one. A pair counts when more
    than half of the votes of its rarer word are for it, with one vote against every pair beforehand, so it takes two
    identifiers at least. Words that ``word_similarity`` finds alike need no learning.
    """
    named = read.where("ident is not null and ident <> ''").groupBy("ident", "palabras").agg(F.count(F.lit(1)).alias("n"))
    main = named.groupBy("ident").agg(F.max(F.struct("n", "palabras")).alias("m")).select("ident", F.split("m.palabras", " ").alias("m"))
    own = F.split("palabras", " ")
    each = named.join(main, "ident").select("ident", F.array_except(own, "m").alias("x"), F.array_except("m", own).alias("y"), (F.size(F.array_intersect(own, "m")) > 0).alias("rest"))
    each = each.where("rest and size(x) = 1 and size(y) = 1").select("ident", F.col("x")[0].alias("x"), F.col("y")[0].alias("y")).where("length(x) > 2 and length(y) > 2")
    votes = each.distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    known = named.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    votes = votes.join(known.select(F.col("w").alias("x"), F.struct("k", F.col("w")).alias("kx")), "x").join(known.select(F.col("w").alias("y"), F.struct("k", F.col("w")).alias("ky")), "y")
    votes = votes.select(F.least("kx", "ky")["w"].alias("corta"), F.greatest("kx", "ky")["w"].alias("larga"), "n").groupBy("corta", "larga").agg(F.sum("n").alias("n"))
    learnt = votes.groupBy("corta").agg(F.sum("n").alias("total"), F.max(F.struct("n", "larga")).alias("best"))
    learnt = learnt.where("best.n > 0.5 * (total + 1)").select("corta", "best.larga")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([word_similarity(x, y) < 0.8 for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    return learnt.mapInArrow(apart, "corta string, larga string")


def written_out(read: DataFrame, forms: DataFrame, stages: Stages) -> DataFrame:
    """``read`` with the words of ``palabras`` that ``forms`` has replaced, in order and without repetition."""
    forms = stages.cut(forms, "forms")
    words = read.select("palabras").distinct()
    each = words.select("palabras", F.explode(F.split("palabras", " ")).alias("corta")).join(forms, "corta")
    changed = each.groupBy("palabras").agg(F.map_from_entries(F.collect_list(F.struct("corta", "larga"))).alias("map"))
    text = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("palabras", " "), lambda w: F.coalesce(F.col("map")[w], w)))), " ")
    changed = changed.select("palabras", text.alias("otras"))
    return read.join(changed, "palabras", "left").withColumn("palabras", F.coalesce("otras", "palabras")).drop("otras")


def numbered(nodes: DataFrame, stages: Stages) -> DataFrame:
    """``nodes`` with ``number``: 0, 1, 2 and so on, half as wide as a hash and far shorter when compressed."""
    marked = stages.cut(nodes.withColumn("mark", F.monotonically_increasing_id()), "marked")
    sizes = sorted(tuple(r) for r in marked.groupBy(F.shiftright("mark", 33).alias("p")).agg(F.count(F.lit(1))).collect())
    starts, total = [], 0
    for p, size in sizes:
        starts.append((p, total))
        total += size
    start = nodes.sparkSession.createDataFrame(starts, "p long, start long")
    number = F.col("start") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    out = marked.join(start, F.shiftright("mark", 33) == start["p"])
    return out.withColumn("number", number.cast("int" if total < 1 << 31 else "long")).drop("mark", "p", "start")


def with_frequencies(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``veces``: for each of the words, in order, the number of names that have it."""
    each = nodes.select("node", F.posexplode(F.split("palabras", " ")).alias("i", "w"))
    n = each.groupBy("w").agg(F.count(F.lit(1)).alias("veces"))
    back = each.hint("merge").join(n, "w").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "veces"))).alias("x"))
    return nodes.join(back.select("node", F.col("x.veces").alias("veces")), "node")


def _hashes(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)


def gram_codes(word: str) -> np.ndarray:
    """64-bit hashes of a word's padded grams."""
    out = []
    for g in grams(word):
        h = 14695981039346656037
        for c in g.encode():
            h = (h ^ c) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        out.append(h ^ h >> 29)
    return np.array(out, np.uint64)


def features(words: list[str], codes: Callable[[str], np.ndarray] = gram_codes) -> np.ndarray:
    """Hashed features of a name: the padded grams of all of its words.

    They depend on the name alone, so a name and its misspelling are compared alike in inputs of any size.
    """
    return np.unique(np.concatenate([codes(w) for w in words]))


def word_weight(word: str, count: int, n: int) -> float:
    """1 up to a hundredth of all names, and less the more of them have the word; half for an initial."""
    weight = min(1.0, max(0.15, math.log(count / n) / math.log(0.01)))
    return weight * (0.5 if len(word) == 1 else 1.0)


def place_words(place: str) -> frozenset[str]:
    return frozenset(place.split("|")[0].split(" "))


def candidates(nodes: DataFrame, stages: Stages, similar: float, idents: DataFrame | None = None) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of nodes of the same ``lugar`` whose features are likely similar.

    MinHash signatures of the features (``features``) are cut into bands; names that agree in a band share a bucket, and
    those that share AGREE buckets are candidates. The rows of a band and the number of bands follow from the collision
    curve at ``similar`` and RECALL. Nodes are distinct names, so copies never fill a bucket. Nodes with an equal
    identifier in ``idents(node, ident)`` are candidates too, however far apart their spellings are.
    """
    return stages.gather(candidate_rounds(nodes, stages, similar, idents), "pairs")


def candidate_rounds(nodes: DataFrame, stages: Stages, similar: float, idents: DataFrame | None = None) -> Iterator[DataFrame]:
    """``candidates`` in parts without a common pair, of a bounded number of bucket pairs each.

    The buckets are written a few bands at a time. Nodes fall into classes by their remainder, and a round has the pairs of
    two classes (or of one) in all buckets, so it knows how many buckets each of them shares.
    """
    n = nodes.count()
    cells = stages.gather(written_cells(nodes, stages, similar, idents, n), "cells")
    total = cells.agg(F.sum("pairs")).first()[0] or 0
    classes = max(1, math.ceil(math.sqrt(2 * total / max(ROUND, PER_NAME * n))))
    for c in range(classes):
        for d in range(c, classes):
            pairs = paired(cells, classes, c, d)
            yield pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= AGREE).select("a", "b")


def written_cells(nodes: DataFrame, stages: Stages, similar: float, idents: DataFrame | None, n: int) -> Iterator[DataFrame]:
    """``bucket_cells`` of the bands, in rounds of a bounded number of rows; those of identifiers count AGREE times."""
    rows, bands = banding(similar, RECALL, MOST_HASHES)
    mult, add = _hashes(rows, bands)
    step = math.ceil(bands / max(1, math.ceil(n * bands / max(ROUND, PER_NAME * n))))
    kind = nodes.schema["node"].dataType.simpleString()

    def signatures(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        m, t = mult[low * rows : high * rows], add[low * rows : high * rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = lru_cache(maxsize=100_000)(gram_codes)
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    sets = [features(t.split(" "), codes) for t in batch.column(1).to_pylist()]
                    signature = np.empty((len(sets), len(m)), np.uint64)
                    for i, s in enumerate(sets):
                        signature[i] = ((s[:, None] * m + t) >> np.uint64(32)).min(0)
                    key = np.full((len(sets), high - low), 1469598103934665603, np.uint64)
                    for r in range(rows):
                        key = (key ^ signature[:, r::rows]) * np.uint64(1099511628211)
                    key = key ^ (np.arange(low, high, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(2), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))],
                        names=["node", "lugar", "bands"],
                    )

        return run

    for low in range(0, bands, step):
        signed = nodes.select("node", "palabras", "lugar").mapInArrow(signatures(low, min(low + step, bands)), f"node {kind}, lugar string, bands array<long>")
        signed = signed.select("node", F.transform("bands", lambda b: F.xxhash64(b, "lugar")).alias("buckets"))
        signed = stages.cut(signed, "signed")
        yield bucket_cells(signed.select("node", F.explode("buckets").alias("bucket")), stages, "bands")
    stages.drop("signed")
    if idents is not None:
        same = nodes.select("node", "lugar").join(idents, "node")
        same = same.select("node", F.explode(F.array(*[F.xxhash64(F.lit("ident"), F.lit(k), "ident", "lugar") for k in range(AGREE)])).alias("bucket"))
        yield bucket_cells(same, stages, "idents")


def bucket_cells(rowed: DataFrame, stages: Stages, tag: str, block: int = BLOCK) -> DataFrame:
    """``(nodes, first, pairs)``: cells that hold, together, each pair of nodes of each bucket of ``rowed(node, bucket)`` once.

    A bucket above ``block`` nodes is cut into blocks by a hash of the node, and every two blocks are a cell of
    their own, so no task holds more than two blocks of a bucket at a time. The ``first`` nodes of such a cell meet the
    others; where ``first`` is 0 all nodes meet each other. ``pairs`` is the number of these; cells without any are left out.
    """
    large = rowed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    large = stages.cut(large.select("bucket", F.ceil(F.col("size") / block).cast("int").alias("parts")), f"large-{tag}")
    cut = rowed.join(large, "bucket", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node", "bucket"), "parts").cast("int")).otherwise(0)
    cut = cut.select("bucket", "node", "parts", part.alias("part"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
    cell = F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    cells = cut.select(cell.alias("cell"), side.alias("side"), "node").repartition("cell").sortWithinPartitions("cell", "side")
    kind = cells.schema["node"].dataType.simpleString()
    return cells.mapInArrow(cell_lists, f"nodes array<{kind}>, first int, pairs long")


def bucket_pairs(rowed: DataFrame, stages: Stages, tag: str, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, ``a < b``: for each bucket of ``rowed(node, bucket)`` all pairs of its nodes, whatever its size.

    A pair comes out once for each bucket.
    """
    return paired(bucket_cells(rowed, stages, tag, block))


def paired(cells: DataFrame, classes: int = 1, c: int = 0, d: int = 0) -> DataFrame:
    """``(a, b)``, ``a < b``: the pairs of all cells; of ``classes`` only those of one end in ``c`` and the other in ``d``."""
    kind = cells.schema["nodes"].dataType.elementType.simpleString()
    return cells.select("nodes", "first").mapInArrow(cell_pairs(classes, c, d), f"a {kind}, b {kind}")


def cell_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each cell, whose rows ``cell, side, node`` follow each other by side, as one row of ``bucket_cells``."""

    def lists(cell: np.ndarray, side: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[start, len(cell)])
        two, first = np.maximum.reduceat(side, start) > 0, np.add.reduceat((side == 1).astype(np.int64), start)
        pairs = np.where(two, first * (size - first), size * (size - 1) // 2)
        keep = pairs > 0
        ends = np.r_[0, np.cumsum(size[keep])].astype(np.int32)
        nodes = pa.ListArray.from_arrays(pa.array(ends), pa.array(node[np.repeat(keep, size)]))
        return pa.RecordBatch.from_arrays([nodes, pa.array(first[keep].astype(np.int32)), pa.array(pairs[keep])], names=["nodes", "first", "pairs"])

    held: list[np.ndarray] = []
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        if len(held[0]):
            last = np.searchsorted(held[0], held[0][-1])  # the last cell may go on in the next batch
            if last:
                yield lists(*[h[:last] for h in held])
                held = [h[last:] for h in held]
    if held and len(held[0]):
        yield lists(*held)


def cell_pairs(classes: int = 1, c: int = 0, d: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads cells ``nodes, first`` and gives the pairs of ``paired``; a node's class is its remainder by ``classes``."""
    most = 500_000

    def out(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = x.ravel(), y.ravel()
        keep = x != y
        if c != d:
            keep &= np.mod(x, classes) != np.mod(y, classes)
        if keep.any():
            x, y = x[keep], y[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def pairs(cell: np.ndarray, side: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[start, len(cell)])
        two = np.maximum.reduceat(side, start) > 0
        for n in np.unique(size[~two]):
            if n > 1:
                i, j = np.triu_indices(n, 1)
                own = start[(size == n) & ~two]
                step = max(1, most // len(i))
                for k in range(0, len(own), step):
                    yield from out(node[own[k : k + step, None] + i], node[own[k : k + step, None] + j])
        for s, n in zip(start[two], size[two]):
            right = side[s : s + n] == 2
            x, y = node[s : s + n][~right], node[s : s + n][right]
            yield from out(np.repeat(x, len(y)), np.tile(y, len(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(0).flatten().to_numpy()
            cell, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            first = batch.column(1).to_numpy()[cell]
            side = np.where(first == 0, 0, np.where(np.arange(len(node)) - start[cell] < first, 1, 2))
            if classes > 1:
                own = np.mod(node, classes)
                keep = (own == c) | (own == d)
                cell, side, node = cell[keep], side[keep], node[keep]
            if len(node):
                yield from pairs(cell, side, node)

    return run


def verified(pairs: DataFrame, nodes: DataFrame, abbreviated: bool = False) -> DataFrame:
    """``(a, b, mx, mn)``: candidate pairs with their Monge-Elkan similarity in the better and worse direction.

    A word weighs 1 up to a hundredth of all names, and less the more of them have it.
    """
    n = nodes.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similar = lru_cache(maxsize=200_000)(abbreviated_similarity if abbreviated else word_similarity)

        @lru_cache(maxsize=200_000)
        def parsed(name: str) -> tuple[list[str], list[float]]:
            words, weights = [], []
            for part in name.split(" "):
                w, _, c = part.partition(":")
                words.append(w)
                weights.append(word_weight(w, int(c), n))
            return words, weights

        places = lru_cache(maxsize=50_000)(place_words)
        for batch in batches:
            mx, mn = [], []
            for x, y, place in zip(*[batch.column(i).to_pylist() for i in range(2, 5)]):
                (a, wa), (b, wb) = parsed(x), parsed(y)
                u, v = monge_elkan(a, b, wa, wb, places(place), similar, abbreviated)
                mx.append(u)
                mn.append(v)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mx, pa.float64()), pa.array(mn, pa.float64())], names=["a", "b", "mx", "mn"])
            yield out.filter(pa.array([u >= LEAST[0] and v >= LEAST[1] for u, v in zip(mx, mn)], pa.bool_()))

    counted = F.array_join(F.zip_with(F.split("palabras", " "), "veces", lambda w, c: F.concat(w, F.lit(":"), c.cast("string"))), " ")
    left = nodes.select(F.col("node").alias("a"), counted.alias("pa"), "lugar")
    right = nodes.select(F.col("node").alias("b"), counted.alias("pb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb", "lugar")
    kind = nodes.schema["node"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}, mx double, mn double")


def near(a: Column, b: Column) -> Column:
    """Identifiers of at least seven digits that differ by a slip: one digit, two swapped, or the last one missing."""
    return (F.length(a) >= 7) & (F.length(b) >= 7) & (F.levenshtein(a, b) <= 2) & (F.abs(F.length(a) - F.length(b)) <= 1)


def profile_links(names: DataFrame, profiles: DataFrame, main: DataFrame, naming: Naming) -> DataFrame:
    """``(p, q, score)`` between profiles (a name with an identifier or none) that mean the same entity.

    A profile is linked to one of a similar name with the same identifier, or to that name's main identifier when
    they differ by a slip; a profile without identifier to the other's profile without one, and to the main one, if
    neither name has a second identifier (else it can't be told which of the namesakes is meant). Every rule
    is an equality of keys with at most one partner for each pair of names, so namesakes are never multiplied.
    """
    prof = lambda node, ident: F.xxhash64(node, F.coalesce(ident, F.lit("")))
    ok = lambda t: (F.col("mx") >= t[0]) & (F.col("mn") >= t[1])
    both = names.unionByName(names.select(F.col("b").alias("a"), F.col("a").alias("b"), "mx", "mn"))
    score = (F.col("mx") + F.col("mn")) / 2
    own = profiles.select(F.col("node").alias("a"), F.col("ident").alias("ia")).join(main.select(F.col("node").alias("a"), F.col("idents").alias("own")), "a")
    far = main.select(F.col("node").alias("b"), "main", "idents", "bare")
    rows = both.join(own, "a").join(far, "b")
    slip = F.col("ia").isNotNull() & F.col("main").isNotNull() & ((F.col("ia") == F.col("main")) | near(F.col("ia"), F.col("main")))
    known = rows.where(slip & ok(naming.agreeing)).select(prof(F.col("a"), F.col("ia")).alias("p"), prof(F.col("b"), F.col("main")).alias("q"), (score + 1).alias("score"))
    bare = F.col("ia").isNull() & (F.col("own") <= 1) & ok(naming.alone)
    to_main = rows.where(bare & F.col("main").isNotNull() & (F.col("idents") == 1)).select(prof(F.col("a"), F.col("ia")).alias("p"), prof(F.col("b"), F.col("main")).alias("q"), score.alias("score"))
    to_bare = rows.where(bare & F.col("bare")).select(prof(F.col("a"), F.col("ia")).alias("p"), prof(F.col("b"), F.lit(None).cast("string")).alias("q"), score.alias("score"))
    twin = profiles.where("ident is not null").select(F.col("node").alias("b"), F.col("ident").alias("ia"))
    second = both.join(own.where("ia is not null"), "a").join(twin, ["b", "ia"]).where(ok(naming.agreeing))
    second = second.select(prof(F.col("a"), F.col("ia")).alias("p"), prof(F.col("b"), F.col("ia")).alias("q"), (score + 1).alias("score"))
    same = main.where(F.col("bare") & F.col("main").isNotNull() & (F.col("idents") == 1))
    same = same.select(prof(F.col("node"), F.lit(None).cast("string")).alias("p"), prof(F.col("node"), F.col("main")).alias("q"), F.lit(1.0).alias("score"))
    links = known.unionByName(to_main).unionByName(to_bare).unionByName(second).unionByName(same)
    return links.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "score").where("p <> q").groupBy("p", "q").agg(F.max("score").alias("score"))


def star_clusters(links: DataFrame, mass: DataFrame, stages: Stages, max_rounds: int = 100) -> DataFrame:
    """``(id, center)`` for every end of ``links(p, q, score)``: each cluster is a center with its neighbours.

    The order of centers is that of the greedy method (rows of a record itself and of its neighbours by score;
    ties by id): in each round all records that rank before all of their open neighbours become centers at once,
    every open neighbour of a center joins the one it is most similar to, and both leave the graph. A round at least
    takes the first record of each connected part; it is written to the shared folder.
    """
    both = links.unionByName(links.select(F.col("q").alias("p"), F.col("p").alias("q"), "score"))
    size = mass.select(F.col("id").alias("q"), F.col("n").alias("nq"))
    degree = both.join(size, "q").groupBy("p").agg(F.sum(F.col("score") * F.col("nq")).alias("d"))
    degree = degree.join(mass.select(F.col("id").alias("p"), "n"), "p").select("p", (F.col("d") + F.col("n")).alias("d"))
    rank = degree.select("p", F.struct(F.round("d", 6).alias("d"), F.col("p").alias("p")).alias("rp"))
    edges = both.join(rank, "p").join(rank.select(F.col("p").alias("q"), F.col("rp").alias("rq")), "q").select("p", "q", "score", "rp", "rq")
    edges = stages.cut(edges, "edges")
    parts = []
    for turn in range(max_rounds):
        first = edges.groupBy("p").agg(F.max("rq").alias("over"), F.first("rp").alias("rp")).where("rp > over").select(F.col("p").alias("center"))
        reached = edges.join(first, edges["p"] == first["center"]).groupBy("q").agg(F.max(F.struct("score", "rp")).alias("b"))
        joined = reached.select(F.col("q").alias("id"), F.col("b.rp.p").alias("center"))
        done = stages.cut(first.select(F.col("center").alias("id"), "center").unionByName(joined), f"done{turn}")
        parts.append(done)
        gone = done.select("id")
        left = edges.join(gone, edges["p"] == gone["id"], "left_anti")
        left = left.join(gone, left["q"] == gone["id"], "left_anti")
        ends = stages.cut(edges.select(F.col("p").alias("id")).distinct().join(gone, "id", "left_anti"), "open")
        edges = stages.cut(left, "edges")
        if edges.limit(1).count() == 0:
            parts.append(ends.select("id", F.col("id").alias("center")))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        # Records whose neighbours have all gone stay alone.
        alone = ends.join(edges.select(F.col("p").alias("id")).distinct(), "id", "left_anti")
        parts.append(stages.cut(alone.select("id", F.col("id").alias("center")), f"alone{turn}"))
    raise RuntimeError(f"records still open after {max_rounds} rounds")


def link_names(
    records: DataFrame, key: str, name: str, naming: Naming, place: Column | None = None, identifier: Column | None = None
) -> DataFrame:
    """``(key, nivel, grupo)`` for each record with a name: its levelled name and the entity it means.

    ``place`` (an exact context, its words separated by blanks, parts by ``|``) restricts comparisons to names of the
    same place; ``identifier`` (digits or null) keeps namesakes apart and confirms weaker spellings. Records of
    equal words, place and identifier are one profile. Null, empty and placeholder names give no row; repeated rows
    come out once; a record delivered under several names comes out with each. Very long names are read whole. An
    empty table gives no row.
    """
    spark = records.sparkSession
    stages = Stages(spark, "names")
    ident = identifier if identifier is not None else F.lit(None).cast("string")
    rows = records.select(records[key].alias("clave"), records[name].alias("__n"), F.coalesce(place, F.lit("")).alias("lugar") if place is not None else F.lit("").alias("lugar"), ident.alias("ident"))
    read = read_names(rows.where("clave is not null and __n is not null").distinct(), "__n", naming).where("palabras is not null")
    read = stages.cut(read.select("clave", "lugar", "ident", "nivel", "palabras"), "read")
    if identifier is not None:
        read = written_out(read, short_forms(read), stages)
    read = stages.cut(read.withColumn("node", F.xxhash64("palabras", "lugar")), "written")
    stages.keep("written")
    counts = read.groupBy("node", "ident").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("ident is not null").groupBy("node").agg(F.max(F.struct("n", F.length("ident").alias("l"), "ident")).alias("m")).select("node", F.col("m.ident").alias("main"))
    # Slips of a name's main identifier are read as the main one.
    read = read.join(top, "node", "left")
    read = read.withColumn("ident", F.when(near(F.col("ident"), F.col("main")), F.col("main")).otherwise(F.col("ident")))
    read = stages.cut(read.withColumn("id", F.xxhash64("node", F.coalesce("ident", F.lit("")))), "named")
    profiles = stages.cut(read.groupBy("id", "node", "ident").agg(F.count(F.lit(1)).alias("n")), "profiles")
    main = read.groupBy("node").agg(F.max("main").alias("main"), F.count_distinct("ident").alias("idents"), F.bool_or(F.col("ident").isNull()).alias("bare"))
    main = stages.cut(main, "main")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit("two names of one hash")))
    nodes = read.groupBy("node").agg(one("palabras").alias("palabras"), one("lugar").alias("lugar"))
    nodes = stages.cut(numbered(with_frequencies(stages.cut(nodes, "words")), stages), "nodes")
    read = stages.cut(read.select("clave", "nivel", "id"), "keys")
    stages.keep("keys", "profiles", "main", "nodes")
    number = nodes.select("node", "number")
    idents = profiles.where("ident is not null").join(number, "node").select(F.col("number").alias("node"), "ident").distinct()
    short = nodes.drop("node").withColumnRenamed("number", "node")
    rounds = candidate_rounds(short, stages, naming.similar, idents)
    found = stages.gather((verified(stages.cut(pairs, "pairs"), short, naming.abbreviated) for pairs in rounds), "verified")
    stages.keep("keys", "profiles", "main", "nodes", "verified")
    for end in "ab":
        found = found.join(number.withColumnRenamed("number", end), end).drop(end).withColumnRenamed("node", end)
    found = stages.cut(found.select("a", "b", "mx", "mn"), "found")
    stages.keep("keys", "profiles", "main", "found")
    links = stages.cut(profile_links(found, profiles, main, naming), "links")
    stages.keep("keys", "profiles", "links")
    clusters = star_clusters(links, profiles.select("id", "n"), stages)
    grouped = read.join(clusters, "id", "left").select("clave", "nivel", F.coalesce("center", "id").alias("grupo"))
    grouped = stages.cut(grouped.distinct(), "grouped")
    stages.keep("grouped")
    return grouped


def variant_pairs(linked: DataFrame) -> DataFrame:
    """``(clave_a, clave_b)``, ``clave_a < clave_b``: records of one group whose levelled names differ.

    The pairs of records are what is asked for, so a group gives as many rows as it has such pairs.
    """
    a = linked.select("grupo", F.col("clave").alias("clave_a"), F.col("nivel").alias("na"))
    b = linked.select("grupo", F.col("clave").alias("clave_b"), F.col("nivel").alias("nb"))
    return a.join(b, "grupo").where("clave_a < clave_b and na <> nb").select("clave_a", "clave_b").distinct()


def digits(c: Column) -> Column:
    """The digits of an identifier; null when there are fewer than six or they are a placeholder."""
    d = F.regexp_replace(c, "[^0-9]", "")
    same = d == F.repeat(F.substring(d, 1, 1), F.length(d))
    return F.when((F.length(d) >= 6) & ~same & ~d.isin(*NO_IDENTIFIER), d)


def levelled(c: Column) -> Column:
    """Upper case without accents and with single blanks; null for empty texts and placeholders."""
    plain = F.translate(F.upper(F.btrim(c)), "ÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÃÕÇ", "AEIOUUNAEIOUAEIOUAOC")
    plain = F.btrim(F.regexp_replace(plain, "[^A-Z0-9]+", " "))
    return F.when((plain != "") & ~F.replace(plain, F.lit(" ")).isin(*sorted(NO_NAME)), plain)


def buyer_place(entities: DataFrame, city: str, department: str, tax_id: str) -> DataFrame:
    """Code, name and ``__place`` of each buyer: its levelled city and department.

    A missing department is that of the city if the city has only one; else that of the rows of the same city
    and identifier, if they have one; else it stays unknown, which is a place of its own.
    """
    rows = entities.select("codigo_entidad", "nombre_entidad", city, department, tax_id).withColumn("__c", F.coalesce(levelled(F.col(city)), F.lit(""))).withColumn("__d", levelled(F.col(department))).withColumn("__t", F.substring(digits(F.col(tax_id)), 1, 9))
    known = rows.where("__d is not null")
    of_city = known.groupBy("__c").agg(F.min("__d").alias("__lo"), F.max("__d").alias("__hi"))
    of_both = known.where("__t is not null").groupBy("__c", "__t").agg(F.min("__d").alias("__lo2"), F.max("__d").alias("__hi2"))
    rows = rows.join(of_city, "__c", "left").join(of_both, ["__c", "__t"], "left")
    filled = F.coalesce("__d", F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")), F.when(F.col("__lo2") == F.col("__hi2"), F.col("__lo2")), F.lit(""))
    return rows.withColumn("__place", F.concat("__c", F.lit("|"), filled)).drop("__c", "__d", "__t", "__lo", "__hi", "__lo2", "__hi2")


def link_buyers(entities: DataFrame) -> DataFrame:
    """``(clave, nivel, grupo)`` of the rows of ``entidades``."""
    placed = buyer_place(entities, "ciudad", "departamento", "nit_entidad")
    return link_names(placed, "codigo_entidad", "nombre_entidad", ORGANISATIONS, F.col("__place"))


def link_representatives(nodes: DataFrame) -> DataFrame:
    """``(clave, nivel, grupo)`` of the representatives in ``nodos``."""
    return link_names(nodes, "id_nodo", "nombre_rep_legal", PEOPLE, None, digits(F.col("doc_rep_legal")))
