"""Language identification by Bayesian evidence fusion.

For each text and language these are added, as logarithms:
- the text's likelihood: mean log probability of its byte trigrams under the
  language's smoothed counts, times at most EVIDENCE trigrams (bytes are not
  independent, so longer texts don't add certainty without end);
- the declared markup language: how often declarations are right, by language;
- the address suffix (top-level domain and language folder): its share in each language;
- the host's prior, smoothed hierarchically: host counts lean on those of the
  host's domain, and these on all rows, PRIOR rows' worth each.
Counts for the last three are grouped aggregates over all rows, by the language that
the text alone suggests.  A uniform model stands for no known language, "und".

Trigram counts come from labelled texts: those of at most TRAIN ids of each label,
the ids with the lowest hashes, and of the LANGUAGES most frequent labels, which
are the bounds of the sample.  A label teaches the model and is no evidence: a
text that is scored brings its words, its host and what its markup or address says.

Null and empty texts have no trigrams: the other evidence decides.  A missing
declaration, address or host adds nothing (the host's prior is then that of all rows).
Languages are those with a label; without any, every row is "und".  Ties go to the
language first in the alphabet.  Repeated rows count each time.  A very long text is
read whole, in parts, and weighs as EVIDENCE trigrams.  An empty table gives an empty one.
Columns of the input keep their names, unless they are called as one of the result's.

Priors of hosts and suffixes are files in the shared folder, which tasks map and search
where the texts lie: no text moves, however many hosts there are or how hot one is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import in_arrow, new_folder, stored, unused
from ._id_table import look_up_all, shard_of, shards_for, write_table
from ._words import groups, text_buffers

TRAIN, LANGUAGES, EVIDENCE, PRIOR = 2_000, 200, 48, 50
UNKNOWN = "und"
#: What a row's chances are of being in no known language, before any evidence.
UNKNOWN_PRIOR = 0.001
#: Shares and their logarithms are kept as integers of this many to one.
SCALE = 10**12
_BITS = 16
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[48:58] = 48  # all digits count as one


def _trigrams(data: np.ndarray) -> np.ndarray:
    """A hash of _BITS for each three bytes."""
    x = _LOWER[data]
    return ((x[:-2] * 65_599 + x[1:-1]) * 65_599 + x[2:]) * np.uint32(2_654_435_761) >> np.uint32(32 - _BITS)


class Model:
    """Log probabilities of trigrams, a column for each language and a last one for none of them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        # a tenth of any text may be anything: codes and names don't make a text foreign
        known = np.log(0.9 * smooth / smooth.sum(axis=0) + 0.1 / (1 << _BITS)) if languages else np.zeros((1 << _BITS, 0))
        self.table = np.concatenate([known, np.full((1 << _BITS, 1), -_BITS * np.log(2))], axis=1).astype(np.float32)

    def likelihoods(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: log likelihoods of the languages, then of none."""
        data, bounds = text_buffers(texts)
        out = np.zeros((len(texts), self.table.shape[1]))
        for a, b in groups(bounds, 250_000):
            part, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            some = np.flatnonzero(np.diff(at) >= 3)
            if not len(some):
                continue
            values = self.table[_trigrams(part)]
            # texts' trigrams end two bytes before the text does; sums of the ranges alternate with what lies between
            edges = np.stack([at[some], at[some + 1] - 2], axis=1).ravel()
            sums = np.add.reduceat(np.concatenate([values, np.zeros((2, values.shape[1]), np.float32)]), edges, axis=0, dtype=np.float64)[::2]
            n = (np.diff(at)[some] - 2)[:, None]
            out[a + some] = sums / n * np.minimum(n, EVIDENCE)
        return out


def train(labelled: DataFrame, label: str = "lang", text: str = "text", id_column: str = "doc_id", most: int = TRAIN) -> Model:
    """From the texts of at most ``most`` ids of each label, for the LANGUAGES labels with the most ids."""
    ids = labelled.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(label).alias("_label")).withColumn("_hash", F.xxhash64("_id"))
    # below this hash lie about four times as many ids of a label as are taken: so many go to a task, not all of them
    below = (F.lit(2.0**64 * 4 * most) / F.col("_n") - F.lit(2.0**63)).alias("_below")
    frequent = ids.groupBy("_label").agg(F.approx_count_distinct("_id").alias("_n")).orderBy(F.desc("_n"), "_label").limit(LANGUAGES)
    limits = frequent.select(F.col("_label").alias("_of"), below)  # LANGUAGES rows at most
    low = ids.join(F.broadcast(limits), F.col("_label") == F.col("_of")).where(F.col("_hash") <= F.col("_below")).select("_label", "_hash", "_id").distinct()
    at = F.row_number().over(Window.partitionBy("_label").orderBy("_hash", "_id"))
    chosen = low.withColumn("_at", at).where(F.col("_at") <= most).select("_id", "_label")
    given = labelled.select(F.col(label).alias("_lang"), F.col(id_column).alias("_own"), F.col(text).alias("_text"))
    rows = given.join(F.broadcast(chosen), (F.col("_own") == F.col("_id")) & (F.col("_lang") == F.col("_label")), "left_semi").select("_lang", "_text")  # most ids a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name in batch.column(0).unique().to_pylist():
                texts = batch.column(1).filter(pa.compute.equal(batch.column(0), name))
                data, bounds = text_buffers(texts)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if b - a >= 3:
                        counts.setdefault(name, np.zeros(1 << _BITS, np.int64))
                        counts[name] += np.bincount(_trigrams(data[a:b]), minlength=1 << _BITS)
        for name, x in counts.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some), pa.array(x[some])], ["lang", "gram", "n"])

    found = rows.transform(in_arrow, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = found.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("grams")).orderBy("lang").collect()  # 2**16 counts a language at most
    counts = np.zeros((1 << _BITS, len(got)), np.float64)
    for k, row in enumerate(got):
        for gram, n in row["grams"]:
            counts[gram, k] = n
    return Model([row["lang"] for row in got], counts)


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(url: Column) -> Column:
    """The top-level domain, and the first folder if it has two letters."""
    top = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([a-z]{2})(?:/|$)", 1)
    return F.when(url.isNotNull(), F.concat_ws("/", top, folder))


def domain_of(host: Column) -> Column:
    """The last two labels of a host; a name without dots is its own domain."""
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)


def markup_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]{0,1000}?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]*>", " "))


def _suggest(rows: DataFrame, model: Model) -> DataFrame:
    """rows (host, domain, declared, suffix, text) with the language that the text suggests in place of the text."""
    names = np.array([*model.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = names[np.argmax(model.likelihoods(batch.column(4)), axis=1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(best.tolist(), pa.string())], ["host", "domain", "declared", "suffix", "guess"])

    return rows.select("host", "domain", "declared", "suffix", "text").transform(in_arrow, run, "host string, domain string, declared string, suffix string, guess string")


class Evidence:
    """Grouped counts: small ones on the driver (languages by languages), those by host and suffix as tables of files, by the name's hash."""

    def __init__(self, rows: DataFrame, model: Model):
        spark, langs = rows.sparkSession, model.languages
        counts = stored(_suggest(rows, model).groupBy("host", "domain", "declared", "suffix", "guess").agg(F.count(F.lit(1)).alias("n")))
        # shares by language: a column for each, smoothed from the level above
        of_each = [F.sum(F.when(F.col("guess") == g, F.col("n")).otherwise(0)).alias(f"c{k}") for k, g in enumerate(langs)] + [F.sum("n").alias("n")]
        by = lambda *keys: counts.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*of_each)
        total = counts.agg(*of_each).na.fill(0).first()
        known = np.array([float(total[k]) for k in range(len(langs))])
        self.whole = (known + 1) / (known.sum() + len(langs)) if langs else known
        array = lambda make: F.array(*(make(k) for k in range(len(langs)))) if langs else F.array().cast("array<double>")
        seen = lambda: sum((F.col(f"c{k}") for k in range(len(langs))), F.lit(0.0))
        smooth = lambda prior: array(lambda k: (F.col(f"c{k}") + PRIOR * prior(k)) / (seen() + PRIOR))
        whole = [float(x) for x in self.whole]
        domains = by("domain").select("domain", smooth(lambda k: F.lit(whole[k])).alias("domain_prior"))
        hosts = by("host", "domain").join(domains, "domain").select("host", smooth(lambda k: F.col("domain_prior")[k]).alias("prior"))
        suffixes = by("suffix").select("suffix", array(lambda k: F.log((F.col(f"c{k}") + PRIOR * 0.01) / F.lit(float(known[k]) + PRIOR))).alias("suffix_log"))
        self.folder, self.shards = new_folder(spark, "language-evidence"), shards_for(counts)
        for name, table, column in (("hosts", hosts, "prior"), ("suffixes", suffixes, "suffix_log")):
            scaled = [F.round(F.col(column)[k] * SCALE).cast("long").alias(f"v{k}") for k in range(len(langs))]
            write_table(table.select(F.xxhash64(table.columns[0]).alias("key"), *scaled), f"{self.folder}/{name}", self.shards)
        # how often a declaration agrees with the text, for each declared language that is known
        right = {r["declared"]: (r["same"], r["n"]) for r in counts.where(F.col("declared").isin(langs)).groupBy("declared").agg(F.sum(F.when(F.col("guess") == F.col("declared"), F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("n")).collect()} if langs else {}
        self.declared = {}
        for k, name in enumerate(langs):
            same, n = right.get(name, (0, 0))
            sure = (same + 8.0) / (n + 10.0)
            row = np.full(len(langs), np.log((1 - sure) / max(1, len(langs) - 1)))
            row[k] = np.log(sure)
            self.declared[name] = row


_EVIDENCE = ("host", "domain", "declared", "suffix", "text")


def with_evidence(df: DataFrame, host: Column, declared: Column, suffix: Column, text: Column) -> tuple[DataFrame, dict[str, str]]:
    """(df with columns of evidence, their names): names that df does not have."""
    names = {x: unused(df, f"_{x}") for x in _EVIDENCE}
    made = (host.cast("string"), domain_of(host.cast("string")), F.lower(declared.cast("string")), suffix.cast("string"), text)
    return df.withColumns(dict(zip(names.values(), made, strict=True))), names


def identify(evidence: tuple[DataFrame, dict[str, str]], model: Model, confidence: float = 0.5) -> DataFrame:
    """The table of with_evidence with language, confidence, text_language and accepted in place of the evidence's columns.

    accepted: the language is a known one, of that confidence at least.
    """
    df, at = evidence
    found = Evidence(df.select(*(F.col(at[x]).alias(x) for x in _EVIDENCE)), model)
    made = ("language", "confidence", "text_language", "accepted")
    kept = [c for c in df.columns if c not in at.values() and c.lower() not in made]
    keys = {x: F.xxhash64(at[x]) for x in ("host", "suffix")}
    more = [F.col(at["declared"]), *(e.alias(unused(df, f"_{x}_{n}")) for x, key in keys.items() for n, e in (("shard", shard_of(key, found.shards)), ("key", key), ("there", F.col(at[x]).isNotNull()))), F.col(at["text"])]
    given = df.select(*kept, *more)
    out_schema = df.select(*kept).withColumns({"language": F.lit(""), "confidence": F.lit(0.0), "text_language": F.lit(""), "accepted": F.lit(True)}).schema
    names, langs, n = np.array([*model.languages, UNKNOWN]), model.languages, len(kept)
    whole, declared, folder, values = found.whole, found.declared, found.folder, [f"v{k}" for k in range(len(model.languages))]

    def of(batch: pa.RecordBatch, table: str, first: int) -> tuple[np.ndarray, np.ndarray]:
        shard, key = (batch.column(first + k).to_numpy() for k in (0, 1))
        there, value = look_up_all(f"{folder}/{table}", shard, key, values)
        return there & batch.column(first + 2).to_numpy(zero_copy_only=False), value / SCALE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = model.likelihoods(batch.column(n + 7))
            total = said.copy()
            if langs:
                there, prior = of(batch, "hosts", n + 1)
                total[:, :-1] += np.log((1 - UNKNOWN_PRIOR) * np.where(there[:, None], prior, whole))
                total[:, -1] += np.log(UNKNOWN_PRIOR)
                for name in batch.column(n).unique().to_pylist():
                    if name in declared:
                        rows = pa.compute.fill_null(pa.compute.equal(batch.column(n), name), False).to_numpy(zero_copy_only=False)
                        total[rows, :-1] += declared[name]
                        total[rows, -1] -= np.log(len(langs))
                there, suffix = of(batch, "suffixes", n + 4)
                total[there, :-1] += suffix[there]
                total[there, -1] += suffix[there].max(axis=1)
            chance = np.exp(total - total.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            best = np.argmax(chance, axis=1)
            sure = chance[np.arange(len(best)), best]
            new = [pa.array(names[best].tolist(), pa.string()), pa.array(sure), pa.array(names[np.argmax(said, axis=1)].tolist(), pa.string()), pa.array((best < len(langs)) & (sure >= confidence))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *new], [*kept, *made])

    return given.transform(in_arrow, run, out_schema)


def document_evidence(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents say their source; their label is what the model learns from, so it is no evidence."""
    none = F.lit(None).cast("string")
    return with_evidence(docs, F.col("source"), none, none, F.col("text"))


def corpus_languages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id or page_id, language, confidence, text_language, accepted of all documents and pages; trigrams from the documents' labels."""
    model = train(docs)
    none = F.lit(None).cast("long")
    rows = lambda found, doc, page: found[0].select(doc.alias("doc_id"), page.alias("page_id"), *(F.col(c).alias(f"_{x}") for x, c in found[1].items()))
    of_docs = rows(document_evidence(docs), F.col("doc_id").cast("long"), none)
    of_pages = rows(with_evidence(pages, host_of(F.col("url")), markup_language(F.col("html")), suffix_of(F.col("url")), html_text(F.col("html"))), none, F.col("page_id").cast("long"))
    return identify((of_docs.unionByName(of_pages), {x: f"_{x}" for x in _EVIDENCE}), model)
