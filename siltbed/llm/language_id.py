"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of
* the likelihood of the text: a letter-trigram model, fitted on a bounded sample of labelled rows
  (the ``SAMPLE`` distinct rows of each language with the smallest hashes), tempered to ``TEMPER`` independent trigrams. Where
  the labels are the rows' own declarations, the rows are split into two folds, and a row's text is judged by the model
  of the other fold, so that its declaration counts once;
* the declared markup language, right with probability ``DECLARED``;
* the address suffix, where one is mapped to a language, right with probability ``SUFFIX``;
* the prior of the host: soft counts of text evidence over all rows of the host, smoothed towards its suffix, which is
  smoothed towards the whole corpus. These are grouped aggregations over all rows, combined before they move.

Every language with ``LEAST`` labelled rows takes part. Tags are two or three letters, which bounds their number; the model takes
128 KB a language. The given pages have suffixes (com, net, org) that name no language, so there the suffix is a level of the
prior alone; ``documents`` have no address, so that level is the corpus itself.

A row without letters is 'und' and rejected, and so is one whose best posterior is below ``ACCEPT``. Null texts are empty;
null or unknown hosts, suffixes and declarations are no evidence; repeated rows count each; other columns are ignored.
With no labelled rows at all every row is 'und' and none is rejected but those without letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltbed.llm import common as C

BUCKETS = 1 << 14  # hashed trigrams of the text model
SAMPLE = 4_000  # labelled rows of each language that the text model is fitted on
LEAST = 5  # labelled rows that make a language
OVER = 4  # times ``SAMPLE`` of the rows that are looked at for the sample
SENT = 400_000  # keys of the sample, some 20 bytes each, that are broadcast at most
TEMPER, DECLARED, SUFFIX, SMOOTH, ACCEPT, LEAST_GRAMS = 60.0, 0.9, 0.8, 20.0, 0.5, 3

# Country suffixes whose sites are mostly in one language.
SUFFIX_LANGUAGES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en",
                    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "cz": "cs", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "hu": "hu", "ro": "ro",
                    "gr": "el", "ru": "ru", "ua": "uk", "tr": "tr", "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh", "ir": "fa", "vn": "vi", "id": "id"}

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def trigram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each position, whether it counts): three bytes of one text, in lower case, of which two at least are letters
    and which hold nothing but letters and spaces."""
    low = C.LOWER[data]
    letter = LETTER[data]
    fine = letter | (data == 0x20)
    n = max(0, len(data) - 2)
    code = (low[:n].astype(np.uint32) << 16) | (low[1:n + 1].astype(np.uint32) << 8) | low[2:n + 2]
    ok = fine[:n] & fine[1:n + 1] & fine[2:n + 2] & (letter[:n].astype(np.int8) + letter[1:n + 1] + letter[2:n + 2] >= 2)
    ends = offsets[1:-1]
    for back in (1, 2):
        at = ends - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), ok


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, lang, bucket, n) of a task's sample."""
    total: dict[tuple[int, str], np.ndarray] = {}
    for batch in batches:
        for part, data, offsets in C.slices(batch):
            bucket, ok = trigram_buckets(data, offsets)
            for i, key in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                a, b = offsets[i], min(offsets[i + 1], len(bucket))
                counts = np.bincount(bucket[a:b][ok[a:b]], minlength=BUCKETS)
                total[key] = total.get(key, 0) + counts
    for (fold, lang), counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([fold] * len(at), pa.int32()), pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                                         names=["fold", "lang", "bucket", "n"])


def clean_label(label: Column) -> Column:
    """The language of a tag such as ``en-GB``: its first part in lower case, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(label)), "^([a-z]{2,3})([-_].*)?$", 1), F.lit(""))


def fold_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(2)).cast("int")


def share(rows: int | Column) -> Column:
    """The share of a language's rows that is looked at, however many there are."""
    return F.least(F.lit(1.0), F.lit(float(OVER * SAMPLE)) / (F.lit(rows) if isinstance(rows, int) else rows))


def sampled(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """(text, lang, fold): of each language in ``sizes`` (lang, count) up to ``SAMPLE`` distinct rows, those with the smallest hashes
    of their keys. Rows below a share of the hashes are looked at, so that a language of any size leaves a bounded number."""
    rank = F.xxhash64(F.lit(17), "k2")
    low = (rank / F.lit(2.0**64) + 0.5) < share(F.col("count"))
    near = labelled.join(F.broadcast(sizes), "lang").filter(low)  # a language is two or three letters, so sizes has 18,252 rows at most
    at = Window.partitionBy("lang").orderBy(rank, "k2")
    some = near.select("lang", "k2").distinct().withColumn("at", F.row_number().over(at))
    chosen = C.materialize(some.filter(F.col("at") <= SAMPLE).select("lang", "k2"), "language-sample")
    if chosen.count() <= SENT:  # beyond it the keys meet the texts in a shuffle
        chosen = F.broadcast(chosen)
    rows = near.join(chosen, ["lang", "k2"], "left_semi").dropDuplicates(["lang", "k2"])
    return rows.select("text", fold_of(F.col("k2")).alias("fold"), "lang")


def fit(labelled: DataFrame, own: bool) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by fold, language and bucket) from (k2, text, lang). With ``own`` labels a fold's model is
    fitted on the other one, else both are fitted on all."""
    sizes = C.materialize(labelled.filter("lang is not null").groupBy("lang").count().filter(F.col("count") >= LEAST), "language-sizes")
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())  # two or three letters each
    if not langs:
        return [], np.zeros((2, 0, BUCKETS), np.float32)
    counts = np.zeros((2, len(langs), BUCKETS))
    rows = sampled(labelled, sizes).mapInArrow(count_rows, "fold int, lang string, bucket int, n long").groupBy("fold", "lang", "bucket").agg(F.sum("n").alias("n"))
    for r in rows.groupBy("fold", "lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).toLocalIterator():
        counts[r["fold"], langs.index(r["lang"]), r["at"]] = r["n"]
    counts = (counts[::-1] if own else np.stack([counts.sum(axis=0)] * 2)) + 0.1
    return langs, np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)


def likelihood_rows(model):
    """A function for mapInArrow over (k2, doc_id, host, suffix, declared, fold, text): the tempered log likelihoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.release()
        tables = model.value
        n_langs = tables.shape[1]
        for batch in batches:
            for part, data, offsets in C.slices(batch):
                bucket, ok = trigram_buckets(data, offsets)
                upto = np.concatenate([[0], np.cumsum(ok)])
                cut = upto[np.minimum(offsets, len(ok))]
                n = np.diff(cut)
                fold = part.column(5).to_numpy(zero_copy_only=False)
                used, its_fold = bucket[ok], np.repeat(fold, n)
                out = np.zeros((part.num_rows, n_langs))
                for k in range(n_langs):
                    sums = np.concatenate([[0.0], np.cumsum(tables[its_fold, k, used], dtype=np.float64)])
                    out[:, k] = sums[cut[1:]] - sums[cut[:-1]]
                out *= (np.minimum(n, TEMPER) / np.maximum(n, 1))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * n_langs, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(5)), pa.array(n, pa.int64()), lists],
                                                 names=["k2", "doc_id", "host", "suffix", "declared", "n_grams", "ll"])

    return run


def shares(scores: Column) -> Column:
    """Probabilities of an array of log scores."""
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def identify(rows: DataFrame, labelled: DataFrame | None = None, suffix_languages: dict[str, str] | None = None) -> DataFrame:
    """(k2, doc_id, declared, language, posterior, n_grams, accepted) of rows (k2, doc_id, text, declared, host, suffix).

    ``labelled`` (k2, text, lang) is what the text model is fitted on, the rows' own declarations where it isn't given;
    ``suffix_languages`` maps address suffixes to languages, by default ``SUFFIX_LANGUAGES``."""
    spark = C.prepared(rows)
    rows = rows.withColumn("declared", clean_label(F.col("declared"))).withColumn("text", F.coalesce("text", F.lit("")))
    own = labelled is None
    if own:
        langs, table = fit(rows.select("k2", "text", F.col("declared").alias("lang")), True)
    else:
        langs, table = fit(labelled.select("k2", F.coalesce("text", F.lit("")).alias("text"), clean_label(F.col("lang")).alias("lang")), False)
    cols = rows.select("k2", F.col("doc_id").cast("long").alias("doc_id"), "host", "suffix", "declared", fold_of(F.col("k2")).alias("fold"), "text")
    schema = "k2 binary, doc_id long, host string, suffix string, declared string, n_grams long, ll array<double>"
    scored = C.materialize(cols.mapInArrow(likelihood_rows(spark.sparkContext.broadcast(table)), schema), "language-text")
    base = ["k2", "doc_id", "declared"]
    enough = F.col("n_grams") >= LEAST_GRAMS
    if not langs:
        return scored.select(*base, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), "n_grams", enough.alias("accepted"))
    some = range(len(langs))
    soft = scored.filter(enough).select("host", "suffix", shares(F.col("ll")).alias("p"))
    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in some]
    by_host = C.materialize(soft.groupBy("host", "suffix").agg(F.count("*").alias("n"), *sums), "language-hosts")
    whole = by_host.agg(F.sum("n"), *[F.sum(f"s{k}") for k in some]).first()
    corpus = [((whole[k + 1] or 0.0) + 1) / ((whole[0] or 0) + len(langs)) for k in some]
    of_suffix = by_host.groupBy("suffix").agg(F.sum("n").alias("m"), *[F.sum(f"s{k}").alias(f"t{k}") for k in some])
    joined = by_host.alias("h").join(of_suffix.withColumnRenamed("suffix", "of"), F.col("suffix").eqNullSafe(F.col("of")))

    def prior(k: int) -> Column:
        above = (F.col(f"t{k}") + SMOOTH * corpus[k]) / (F.col("m") + SMOOTH)
        return F.log(F.when(F.col("host").isNull(), above).otherwise((F.col(f"s{k}") + SMOOTH * above) / (F.col("n") + SMOOTH)))

    priors = C.materialize(joined.select("host", "suffix", F.array(*[prior(k) for k in some]).alias("prior")), "language-priors")
    key = [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(f"key_{c}") for c in ("host", "suffix")]
    rows2 = scored.select("*", *key).join(priors.select(*key, "prior"), ["key_host", "key_suffix"], "left")
    names = F.array(*map(F.lit, langs))

    def evidence(said: Column, right: float):
        """A function of the index of a language: the log factor of a tag that is right with a probability."""
        at = F.coalesce(F.array_position(names, said), F.lit(0))
        wrong = float(np.log((1 - right) / max(1, len(langs) - 1)))
        return lambda k: F.when(at == 0, 0.0).when(at == k + 1, float(np.log(right))).otherwise(wrong)

    known = suffix_languages if suffix_languages is not None else SUFFIX_LANGUAGES
    of_address = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("suffix")] if known else F.lit(None).cast("string")
    declared, address = evidence(F.col("declared"), DECLARED), evidence(of_address, SUFFIX)
    far = F.array(*[F.lit(float(np.log(c))) for c in corpus])  # hosts without text evidence
    plain = F.zip_with("ll", F.coalesce("prior", far), lambda x, y: x + y)
    score = F.transform(plain, lambda x, k: x + declared(k) + address(k))
    out = rows2.select(*base, "n_grams", score.alias("s"))
    top = F.array_max("s")
    sure = 1 / F.aggregate(F.transform("s", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, v: a + v)
    best = F.element_at(names, F.array_position("s", top).cast("int"))
    out = out.select(*base, "n_grams", sure.alias("p"), best.alias("lang"))
    return out.select(*base, F.when(enough, F.col("lang")).otherwise("und").alias("language"),
                      F.when(enough, F.col("p")).otherwise(0.0).alias("posterior"), "n_grams", (enough & (F.col("p") >= ACCEPT)).alias("accepted"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of the table ``documents``: its language column is the declaration, its source the host."""
    return docs.select(C.text_key(F.col("doc_id"), F.col("text")).alias("k2"), "doc_id", "text", F.col("lang").alias("declared"),
                       F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def document_labels(docs: DataFrame) -> DataFrame:
    """(k2, text, lang) of the table ``documents``."""
    return docs.select(C.text_key(F.col("doc_id"), F.col("text")).alias("k2"), "text", "lang")


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of the table ``pages``: the html element's language, the address's host and its last label."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    return pages.select(C.text_key(F.col("page_id"), F.col("html")).alias("k2"), F.col("page_id").alias("doc_id"), bare.alias("text"),
                        F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
                        host.alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known well enough."""
    rejected = identify(document_rows(docs)).filter(~F.col("accepted")).select(F.col("k2").alias(C.KEY)).distinct()
    return C.keyed(docs).join(C.materialize(rejected, "language-rejected"), C.KEY, "left_anti").select(*docs.columns)
