"""Language of documents and of their passages by Bayesian fusion of text, label, address and host evidence."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.session import Stages

LANGS = ["es", "en", "pt", "fr", "it"]
#: Usual notations of a label, without case, accents, blanks and region (fixed values).
NOTATIONS = {
    "es": "es spa esp castellano castilian espanol spanish espagnol spagnolo espanhol",
    "en": "en eng ingles english anglais inglese",
    "pt": "pt por portugues portuguese portugais portoghese",
    "fr": "fr fra fre frances francais french francese",
    "it": "it ita italiano italian italien",
}
#: Most frequent words that the model keeps; bounds what is sent to the executors.
MODEL_WORDS = 50_000
#: Distinct (language, word) counts that a task holds before it passes them on.
FLUSH_WORDS = 200_000
#: A sentence speaks for itself from this many words and this log-odds on.
WHOLE_WORDS, WHOLE_ODDS = 4, 4.0

_MARKUP = re.compile(r"<br\s*/?>|</?(?:p|div|li|td|tr|h\d)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|&[a-z]{2,8};|&#\d+;|https?://\S+|www\.\S+|(?<!\S)[^\s\d@]*+[\d@]\S*?(?=[.!?;:,)\]\"'»”]*(?:\s|$))", re.I)
_LINE = re.compile(r"[\r\n]+|(?<=[.!?;:)\]\"'»”])\s+(?:/\s+)?(?=\S)|\s/\s|(?<=[.!?])(?=[(\[])")
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"https?://[^/\s:]*\.([a-z]{2,})(?![\w.])", re.I)
_DECLARED = re.compile(r"<[a-z][^<>]*?\blang\s*=\s*[\"']?\s*([a-z]+)", re.I)


@lru_cache(maxsize=200_000)
def level(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def label_language(c: Column) -> Column:
    """The language that a label names in any usual notation, or null."""
    plain = F.lower(F.translate(F.btrim(c), "áéíóúñçâêôãõàèìòùëïüÁÉÍÓÚÑÇÂÊÔÃÕ", "aeiouncaeoaoaeioueiuAEIOUNCAEOAO"))
    head = F.regexp_extract(plain, r"^([a-z]+)", 1)
    out = F.lit(None).cast("string")
    for lang, names in NOTATIONS.items():
        out = F.when(head.isin(*names.split()), F.lit(lang)).otherwise(out)
    return out


def blank_out(m: re.Match) -> str:
    return " " * len(m.group())


def passages(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and lines; markup and addresses belong to no word but keep their place."""
    spans, at = [], 0
    for m in _LINE.finditer(text):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def clean(text: str) -> str:
    """The text of the same length with markup, addresses, numbers and codes blanked, line breaks for block markup."""
    text = _MARKUP.sub(lambda m: "\n" + " " * (len(m.group()) - 1), text)
    return _TAG.sub(blank_out, text)


def words_of(passage: str) -> tuple[list[str], int]:
    """Levelled words that can tell a language, and the number of letters of all words.

    A capitalised word inside a passage in mixed case is taken for a name and tells nothing.
    """
    raw = _WORD.findall(unicodedata.normalize("NFC", passage))
    letters = sum(map(len, raw))
    if not passage.isupper():
        raw = [w for i, w in enumerate(raw) if i == 0 or not w[0].isupper()]
    return [x for w in raw for x in level(w).split()], letters


_TOKENS = "array<struct<desde:int,hasta:int,palabras:int,letras:int,texto:string>>"


def tokens(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the address suffix, the language that markup declares, and each passage with its words.

    The one pass over the texts; all later steps read what it leaves. Texts of any length are read whole.
    """
    schema = df.select(*keep).schema.simpleString()[len("struct<") : -1]
    kind = pa.list_(pa.struct([("desde", pa.int32()), ("hasta", pa.int32()), ("palabras", pa.int32()), ("letras", pa.int32()), ("texto", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, suffixes, marked = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                t = t or ""
                address, declared = _ADDRESS.search(t), _DECLARED.search(t)
                suffixes.append(address.group(1).lower() if address else None)
                marked.append(declared.group(1).lower() if declared else None)
                t, out = clean(t), []
                for a, b in passages(t):
                    words, letters = words_of(t[a:b])
                    if letters:
                        out.append({"desde": a, "hasta": b, "palabras": len(words), "letras": letters, "texto": " ".join(words)})
                found.append(out)
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(suffixes, pa.string()), pa.array(marked, pa.string()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "sufijo", "marcado", "frases"])

    rows = df.select(*keep, df[text].alias("__text"))
    return rows.mapInArrow(run, f"{schema},sufijo string,marcado string,frases {_TOKENS}")


def count_words(read: DataFrame, lang: str) -> DataFrame:
    """Number of each word in the texts of each language, counted within tasks first: ``lang, word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = [(l, w) for l, c in counts.items() for w in c]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())],
                names=["lang", "word", "n"],
            )

        counts: dict[str, Counter] = {}
        for batch in batches:
            for l, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(l, Counter()).update(w for t in said for w in t.split())
                if sum(map(len, counts.values())) > FLUSH_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    rows = read.where(F.col(lang).isNotNull()).select(lang, F.col("frases.texto"))
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class TextModel:
    """Log-likelihoods of words by language, with letter triples for words it has not kept.

    Built from counts of at most MODEL_WORDS words. A word's likelihood is smoothed towards what its letter triples
    say; labels are wrong for part of the texts, so a word's log-odds are clipped.
    """

    def __init__(self, counts: dict[str, list[int]]):
        words = list(counts)
        n = np.array([counts[w] for w in words], np.float64).reshape(len(words), len(LANGS))
        size = n.sum(0) + 1.0
        triples: dict[str, np.ndarray] = {}
        for w, row in zip(words, np.sqrt(n / size * 1e6)):
            for g in letter_triples(w):
                triples[g] = triples.get(g, 0) + row
        total = sum(triples.values()) if triples else np.ones(len(LANGS))
        self.triples = {g: np.log((v + 1.0) / (total + len(triples))).astype(np.float32) for g, v in triples.items()}
        rate = n / size + 2e-6
        log = np.log(rate)
        log -= log.mean(1, keepdims=True)
        self.words = {w: np.clip(r, -4, 4).astype(np.float32) for w, r in zip(words, log)}


def letter_triples(word: str) -> list[str]:
    p = f"^{word}$"
    return [p[i : i + 3] for i in range(len(p) - 2)]


class Scores(dict):
    """Row of each word in ``table``, the words' log-likelihoods by language relative to the mean of the languages.

    A word that the model has not kept gets the mean of its letter triples, or nothing, and a row of its own.
    """

    def __init__(self, model: TextModel) -> None:
        super().__init__({w: i + 1 for i, w in enumerate(model.words)})
        self.rows, self.model, self.triples = [np.zeros(len(LANGS)), *model.words.values()], len(self) + 1, model.triples
        self.table = np.array(self.rows, np.float64)

    def __missing__(self, word: str) -> int:
        g = [self.triples[x] for x in letter_triples(word) if x in self.triples]
        if not g:
            self[word] = 0
            return 0
        v = np.mean(g, 0)
        self.rows.append(np.clip(v - v.mean(), -1, 1))
        self[word] = len(self.rows) - 1
        return len(self.rows) - 1

    def of(self, texts: list[str]) -> np.ndarray:
        """Sum over the words of each text."""
        if len(self.rows) > self.model + FLUSH_WORDS:
            for w in [w for w, i in self.items() if i >= self.model or not i]:
                del self[w]
            del self.rows[self.model :]
            self.table = self.table[: self.model]
        words = [t.split() for t in texts]
        at = np.cumsum([0, *map(len, words)])
        ids = np.fromiter((self[w] for part in words for w in part), np.int64, at[-1])
        if len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.float64)])
        # A last row of zeros stands behind the last text; a text without words has no sum.
        out = np.add.reduceat(np.r_[self.table[ids], np.zeros((1, len(LANGS)))], at[:-1], 0) if len(words) else np.empty((0, len(LANGS)))
        out[np.diff(at) == 0] = 0
        return out


def fit(read: DataFrame, lang: str) -> TextModel:
    """Model of the words in texts whose label names a language; all labelled rows are counted."""
    by_word = count_words(read, lang).groupBy("word").agg(
        *[F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("n"))), F.lit(0)).alias(l) for l in LANGS]
    )
    total = sum((F.col(l) for l in LANGS), F.lit(0))
    top = by_word.where(total >= 2).orderBy(total.desc(), "word").limit(MODEL_WORDS).collect()
    return TextModel({r["word"]: [r[l] for l in LANGS] for r in top})


_PASSAGE = "array<struct<desde:int,hasta:int,palabras:int,letras:int,odds:array<float>>>"


def read_passages(read: DataFrame, keep: list[str], model: TextModel) -> DataFrame:
    """The columns ``keep``, each passage's span, size and log-likelihoods, and ``leido``, the language of a text that is clear.

    ``odds`` is relative to the mean of the languages.
    """
    sent = read.sparkSession.sparkContext.broadcast(model)
    schema = read.select(*keep).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(sent.value)
        for batch in batches:
            said = batch.column(len(keep))
            parts = said.flatten()
            odds = scores.of(parts.field(4).to_pylist())
            size = pa.compute.list_value_length(said).to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(size)].astype(np.int32)
            whole = np.array([odds[i:j].sum(0) for i, j in zip(at[:-1], at[1:])]).reshape(-1, len(LANGS))
            order = np.sort(whole, 1)
            clear = order[:, -1] - order[:, -2] >= WHOLE_ODDS
            best = [LANGS[i] if c else None for i, c in zip(whole.argmax(1), clear)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(odds) + 1, dtype=np.int32) * len(LANGS)), pa.array(odds.astype(np.float32).ravel(), pa.float32()))
            each = pa.StructArray.from_arrays([*[parts.field(i) for i in range(4)], flat], names=["desde", "hasta", "palabras", "letras", "odds"])
            columns = [batch.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(pa.array(at), each), pa.array(best, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "pasajes", "leido"])

    return read.select(*keep, "frases").mapInArrow(run, f"{schema},pasajes {_PASSAGE},leido string")


_JUDGED = "array<struct<desde:int,hasta:int,palabras:int,letras:int,lang:string,confianza:double,entera:boolean>>"


def judge(read: DataFrame, key: str) -> DataFrame:
    """``key, declarada, lang, confianza, pasajes`` from passages and the ``prior`` of their text, by whole batches."""
    fields = [f for f in read.select("__k", "declarada").schema.fields]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip((key, "declarada"), fields))

    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, k = pa.array(LANGS), len(LANGS)
        for batch in batches:
            said, n = batch.column(2), batch.num_rows
            if not n:
                continue
            prior = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            parts = said.flatten()
            odds = parts.field(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k)
            letters, count = (parts.field(i).to_numpy(zero_copy_only=False) for i in (3, 2))
            size = pa.compute.list_value_length(said).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(n), size)
            post = softmax(odds + prior[doc]) if len(odds) else odds
            lang = post.argmax(1) if len(odds) else np.empty(0, np.int64)
            sure = post.max(1) if len(odds) else np.empty(0)
            order = np.sort(odds, 1)
            entire = (count >= WHOLE_WORDS) & (order[:, -1] - order[:, -2] >= WHOLE_ODDS)
            mass = np.bincount(doc * k + lang, letters * sure, n * k).reshape(n, k)
            said_in = np.bincount(doc * k + lang, letters, n * k).reshape(n, k)
            alone = softmax(prior)
            some = size > 0
            best = np.where(some, mass.argmax(1), alone.argmax(1))
            trust = np.where(some, mass.max(1) / np.maximum(said_in[np.arange(n), best], 1), alone.max(1))
            each = pa.StructArray.from_arrays([*[parts.field(i) for i in range(4)], names.take(pa.array(lang)), pa.array(sure), pa.array(entire)], names=["desde", "hasta", "palabras", "letras", "lang", "confianza", "entera"])
            at = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(trust), pa.ListArray.from_arrays(at, each)], names=[key, "declarada", "lang", "confianza", "pasajes"])

    return read.select("__k", "declarada", "pasajes", "prior").mapInArrow(run, f"{schema}, lang string, confianza double, pasajes {_JUDGED}")


def _vector(values: list[Column]) -> Column:
    return F.array(*values)


def _counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(_vector([F.sum(F.when(F.col("leido") == l, 1.0).otherwise(0.0)) for l in LANGS]).alias("n"))


def _smoothed(n: Column, towards: Column, mass: float) -> Column:
    """Counts smoothed towards a distribution with the weight of ``mass`` rows."""
    total = F.aggregate(n, F.lit(0.0), lambda s, y: s + y)
    return F.zip_with(n, towards, lambda a, p: (a + mass * p) / (total + mass))


def _log(v: Column) -> Column:
    return F.transform(v, lambda p: F.log(p))


def _add(*vectors: Column) -> Column:
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda a, b: a + b)
    return out


def identify(df: DataFrame, key: str, text: str, label: str, host: str, group: str) -> DataFrame:
    """Language and confidence of every text and of each of its passages.

    Columns: ``key``, ``declarada`` (the language that the label names, or null), ``lang``, ``confianza``,
    ``pasajes`` (array of ``desde, hasta, palabras, letras, lang, confianza, entera``; spans count characters).

    The evidence is combined as independent log-likelihoods: the words of the text; the declared label, through
    the table of how labels go with read languages; the language declared in markup and the suffix of an address in
    the text, through such tables; and the prior of the text's host, whose counts are smoothed towards those of its group and those
    towards the whole corpus. All tables come from grouped aggregations over all documents; the ones by label and by
    group are joined by their key like that of the hosts, whatever their size. A document has the language with
    most letters among its passages; passages that say little lean on the other evidence.

    ``entera`` marks passages that are a whole sentence: at least WHOLE_WORDS words, read with log-odds of
    WHOLE_ODDS. Texts that are null, empty or without words have no passages, and the label, host and group decide
    (``confianza`` is then that of the prior). Null labels, hosts and groups are values of their own. Repeated rows
    come out repeated.
    """
    spark = df.sparkSession
    stages = Stages(spark, "langid")
    base = df.select(df[key].alias("__k"), df[text].alias("__t"), label_language(df[label]).alias("declarada"), F.col(host).alias("__host"), F.col(group).alias("__group"))
    said = stages.cut(tokens(base, "__t", ["__k", "declarada", "__host", "__group"]), "tokens")
    model = fit(said, "declarada")
    read = stages.cut(read_passages(said, ["__k", "declarada", "__host", "__group", "sufijo", "marcado"], model), "read")

    sure = read.where("leido is not null")
    flat = F.array(*[F.lit(1.0 / len(LANGS))] * len(LANGS))
    overall = _counts(sure, []).select(_smoothed(F.coalesce("n", F.array(*[F.lit(0.0)] * len(LANGS))), flat, 5.0).alias("__all"))
    groups = _counts(sure, ["__group"]).crossJoin(F.broadcast(overall)).select("__group", _smoothed(F.col("n"), F.col("__all"), 20.0).alias("__g"))
    hosts = _counts(sure, ["__host"]).select("__host", F.col("n").alias("__h"))

    def table_of(column: str, name: str) -> DataFrame:
        """log P(value | language), smoothed by one row a value."""
        seen = _counts(sure, [column])
        total = _counts(sure, []).select(F.col("n").alias("__n"))
        return seen.crossJoin(F.broadcast(total)).select(column, F.zip_with("n", "__n", lambda a, t: F.log((a + 1.0) / (t + 10.0))).alias(name))

    none = F.array(*[F.lit(0.0)] * len(LANGS))
    for right, column in ((groups, "__group"), (hosts, "__host"), (table_of("declarada", "__l"), "declarada"), (table_of("sufijo", "__s"), "sufijo"), (table_of("marcado", "__x"), "marcado")):
        side = right.withColumnRenamed(column, "__on")
        read = read.join(side, read[column].eqNullSafe(side["__on"]), "left").drop("__on")
    read = read.crossJoin(F.broadcast(overall))
    prior = _smoothed(F.coalesce("__h", none), F.coalesce("__g", "__all"), 10.0)
    read = read.withColumn("prior", _add(_log(prior), F.coalesce("__l", none), F.coalesce("__s", none), F.coalesce("__x", none)))
    return stages.cut(judge(read, key), "judged")


def label_cases(identified: DataFrame, key: str) -> DataFrame:
    """``(key, tipo, lang)``: labels to set right (``etiqueta``) and languages of mixed texts (``mezcla``)."""
    worded = identified.where(F.size("pasajes") > 0)
    labels = worded.where("declarada is null or declarada <> lang").select(key, F.lit("etiqueta").alias("tipo"), "lang")
    spoken = F.array_distinct(F.transform(F.filter("pasajes", lambda p: p["entera"]), lambda p: p["lang"]))
    mixed = worded.withColumn("__s", spoken).where(F.size("__s") > 1).select(key, F.lit("mezcla").alias("tipo"), F.explode("__s").alias("lang"))
    return labels.unionByName(mixed)
