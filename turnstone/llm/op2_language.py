"""Operator 2, language identification by Bayesian evidence fusion.

A document's language is judged from its text (byte trigrams, counted over all documents by declared language), the
language that its markup declares, the suffix of its address and its host. Host priors are smoothed towards the domain's,
those towards the corpus's; all are grouped sums of the texts' own posteriors, so no single declaration is believed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import cut, small, small_batches, table, tucked, type_of
from turnstone.llm.textbatch import slices

#: Modelled wherever they are declared at all; any other declared language needs some text, see text_model().
LANGUAGES = ("de", "en", "es", "fr")
#: Nats a trigram by which a further language's model must explain its own texts better than each other's model does.
ALIKE = 0.2
#: Hashed dimensions of trigrams; trigrams at which a text's evidence counts half (neighbours aren't independent).
BITS, HALF = 15, 100.0
#: Documents' worth of a parent's shares in a child's prior; least posterior that is accepted.
SMOOTH, LEAST = 20.0, 0.7
#: Log prior of a text in none of the languages, whose trigrams are all alike.
OTHER = -6.0


def _grams(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, document) at every byte that has two more of its document after it; those with digits say nothing on
    the language and are left out."""
    n = len(data) - 2
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = data.astype(np.uint32)
    gram = ((wide[:n] << 16 | wide[1 : n + 1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    digit = (data >= 48) & (data <= 57)
    held = (doc[:n] == doc[2:]) & ~(digit[:n] | digit[1 : n + 1] | digit[2:])
    return gram[held], doc[:n][held]


def _count(batches, languages: tuple[str, ...], bits: int):
    """(code, text) to (language, gram, n), one line for each pair that the task saw."""
    tally = np.zeros((len(languages), 1 << bits), np.int64)
    for part, data, at in slices(batches, lower=True):
        number = {x: k for k, x in enumerate(languages)}
        known = np.array([number.get(x, -1) for x in part.column("code").to_pylist()], np.int64)
        gram, doc = _grams(data, at, bits)
        which = known[doc]
        tally += np.bincount((which[which >= 0] << bits) + gram[which >= 0].astype(np.int64), minlength=tally.size).reshape(tally.shape)
    k, g = np.nonzero(tally)
    yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(tally[k, g])], names=["language", "gram", "n"])


def declared_languages(rows: DataFrame, bits: int = BITS) -> tuple[str, ...]:
    """The languages to model: those of LANGUAGES that rows (code, text) declare, then all other codes with at least as
    much text as the smoothing of a model adds (16 KB), the largest first; LANGUAGES where nothing is declared."""
    found = rows.filter("code != ''").groupBy("code").agg(F.sum(F.octet_length("text")).alias("size")).filter(F.col("size") > 0)
    sizes = {r["code"]: r["size"] for r in found.filter(F.col("code").isin(*LANGUAGES) | (F.col("size") >= (1 << bits) // 2)).collect()}
    return (*[x for x in LANGUAGES if x in sizes], *sorted(sizes.keys() - set(LANGUAGES), key=lambda x: (-sizes[x], x))) or LANGUAGES


def text_model(rows: DataFrame, languages: tuple[str, ...] | None = None, bits: int = BITS) -> tuple[tuple[str, ...], np.ndarray]:
    """The languages, and log shares of trigrams by language and, last, alike for none.

    Without `languages` they are the declared ones, by the codes (2 or 3 letters) that declarations begin with. A code
    beyond LANGUAGES whose texts another's model explains as well ('eng', or a wrong one on English texts) is that other
    language: its counts join it. languages * 2^bits numbers come to the driver.
    """
    coded = rows.select(F.regexp_extract(F.lower("declared"), r"^\s*([a-z]{2,3})(?![a-z0-9])", 1).alias("code"), "text")
    fixed = languages is not None
    languages = languages if fixed else declared_languages(coded, bits)
    counted = coded.mapInArrow(lambda it: _count(it, languages, bits), "language int, gram int, n long")
    found = counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas()
    tally = np.full((len(languages), 1 << bits), 0.5)
    np.add.at(tally, (found.language, found.gram), found.n)
    logs = np.log(tally / tally.sum(1, keepdims=True))
    taken: list[int] = []
    for k, name in enumerate(languages):
        own = (tally[k] - 0.5) / max((tally[k] - 0.5).sum(), 1.0)
        gains = [own @ (logs[k] - logs[m]) for m in taken]
        if fixed or name in LANGUAGES or not taken or min(gains) >= ALIKE:
            taken.append(k)
        else:
            into = taken[int(np.argmin(gains))]
            tally[into] += tally[k] - 0.5
            logs[into] = np.log(tally[into] / tally[into].sum())
    model = np.concatenate([logs[taken], np.full((1, 1 << bits), -np.log(float(1 << bits)))]).T.astype(np.float32)
    return tuple(languages[k] for k in taken), model


def _evidence(batches, model: np.ndarray, bits: int, carry: list[str]):
    """Adds evidence: the text's log likelihoods less the largest, weighed by n_grams -> HALF n / (n + HALF).

    Lettered are texts with letters, but not those of whose trigrams each has a digit.
    """
    kinds = model.shape[1]
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(97, 123), *range(128, 256)]] = True
    for part, data, at in slices(batches, lower=True):
        n = part.num_rows
        gram, doc = _grams(data, at, bits)
        total = np.stack([np.bincount(doc, model[gram, k], minlength=n) for k in range(kinds)], 1)
        count = np.bincount(doc, minlength=n)
        mean = total / np.maximum(count, 1)[:, None]
        evidence = (mean - mean.max(1, keepdims=True)) * (HALF * count / (count + HALF))[:, None]
        letters = np.concatenate([[0], np.cumsum(ascii_letter[data])])
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        none = (letters[at[1:]] == letters[at[:-1]]) | ((count == 0) & (digits[at[1:]] > digits[at[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * kinds), pa.array(evidence.ravel()))
        out = [*[part.column(c) for c in carry], lists, pa.array(~none)]
        yield pa.record_batch(out, names=[*carry, "__evidence", "__lettered"])


#: What groups are counted by, besides the text.
GROUPS = ("declared", "suffix", "domain", "host")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(table_: DataFrame, by: list[str], kinds: int) -> DataFrame:
    """The summed posteriors by group, as one array."""
    sums = table_.groupBy(*by).agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(kinds)])
    return sums.select(*by, F.array(*[f"p{k}" for k in range(kinds)]).alias("sums"))


def identify(rows: DataFrame, carry: list[str], languages: tuple[str, ...] | None = None, bits: int = BITS, least: float = LEAST) -> DataFrame:
    """The columns `carry` of rows, which have text, declared, suffix, domain and host too, and __language, __posterior and
    __accepted.

    Accepted are texts with letters whose best language has a posterior of `least` or more. Null or empty declarations,
    suffixes, domains and hosts are a value of their own, '', that carries its own (weak) evidence. Texts are scored once;
    what goes on from there is a written table of the carried columns and the evidence, without the text unless carried.
    """
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in GROUPS}
    rows = rows.withColumns(blank)
    small_batches(rows.sparkSession)
    languages, model = text_model(rows, languages, bits)
    kinds, spark = len(languages) + 1, rows.sparkSession
    held = spark.sparkContext.broadcast(model)
    names = [*carry, *GROUPS]
    schema = ", ".join(f"`{c}` {type_of(rows, c)}" for c in names) + ", __evidence array<double>, __lettered boolean"
    scored = cut(rows.select(*names, *[c for c in ["text"] if c not in names]).mapInArrow(lambda it: _evidence(it, held.value, bits, names), schema))
    flat = F.array(*[F.element_at("__evidence", k + 1) + (F.lit(OTHER) if k == kinds - 1 else F.lit(0.0)) for k in range(kinds)])
    own = scored.filter("__lettered").withColumn("__own", _softmax(flat))
    sums = cut(own.groupBy("declared", "suffix", "domain", "host").agg(*[F.sum(F.element_at("__own", k + 1)).alias(f"p{k}") for k in range(kinds)]))
    # parents before children: corpus, domain, host
    corpus = _sums(sums, [], kinds).first()
    total = [float(x or 0.0) + 1.0 / kinds for x in (corpus["sums"] if corpus and corpus["sums"] else [0.0] * kinds)]
    base = [x / sum(total) for x in total]
    root = F.array(*[F.lit(x) for x in base])

    def smoothed(own_sums: Column, parent: Column) -> Column:
        size = F.aggregate(own_sums, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(own_sums, parent, lambda x, p: (x + SMOOTH * p) / (size + SMOOTH))

    domains = _sums(sums, ["domain"], kinds).select("domain", smoothed(F.col("sums"), root).alias("domain_prior"))
    hosts = cut(_sums(sums, ["domain", "host"], kinds).join(domains, "domain").select("domain", "host", smoothed(F.col("sums"), F.col("domain_prior")).alias("__prior")))

    def ratio(by: str) -> DataFrame:
        # P(value | language) / P(value), smoothed to 1 for rare values
        size = F.aggregate("sums", F.lit(0.0), lambda a, b: a + b)
        return cut(_sums(sums, [by], kinds).select(by, F.zip_with("sums", root, lambda x, p: F.log((x + SMOOTH * p) / (size + SMOOTH) / p)).alias(f"__{by}")))

    declared, suffixes = ratio("declared"), ratio("suffix")
    full = scored.join(small(hosts), ["domain", "host"], "left").join(small(declared), ["declared"], "left").join(small(suffixes), ["suffix"], "left")
    zero = F.array(*[F.lit(0.0)] * kinds)
    prior = F.transform(F.coalesce("__prior", root), lambda p: F.log(F.greatest(p, F.lit(1e-9))))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("__evidence"), prior), add(F.coalesce("__declared", zero), F.coalesce("__suffix", zero)))
    posterior = full.withColumn("__logs", F.when(F.col("__lettered"), logs)).withColumn("__all", _softmax(F.col("__logs")))
    best = F.array_position("__all", F.array_max("__all"))
    named = F.array(*[F.lit(x) for x in languages], F.lit("und"))
    posterior = posterior.withColumn("__language", F.coalesce(F.element_at(named, F.when(best > 0, best.cast("int"))), F.lit("und"))).withColumn("__posterior", F.coalesce(F.array_max("__all"), F.lit(0.0)))
    accepted = (F.col("__language") != "und") & (F.col("__posterior") >= least)
    return posterior.withColumn("__accepted", accepted).select(*carry, "__language", "__posterior", "__accepted")


def document_evidence(docs: DataFrame) -> DataFrame:
    """docs with the evidence that documents have: lang is what was declared, the source stands for the host."""
    return docs.withColumns({"declared": F.lower("lang"), "suffix": F.lit(""), "domain": F.lit(""), "host": F.col("source")})


#: Under a country's suffix these are no domains of their own, so that a domain has one label more.
SECOND = "ac|co|com|edu|gob|gov|go|mil|ne|net|nom|or|org"


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, declared, suffix, domain, host) of raw pages; markup, scripts and styles are no text.

    A domain is a host's last two labels, or three as in x.co.uk; a numeric address has no suffix and is its own domain.
    """
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[#\w]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    number = F.col("host").rlike(r"^\d+(\.\d+){3}$")
    return pages.select("page_id", "url", bare.alias("text"), declared.alias("declared"), host.alias("host")).withColumns({
        "suffix": F.when(number, "").otherwise(F.regexp_extract("host", r"([^.]+)$", 1)),
        "domain": F.when(number, F.col("host")).otherwise(F.regexp_extract("host", rf"([^.]+\.(?:{SECOND})\.[a-z]{{2}}|[^.]+\.[^.]+)$", 1)),
    })


def languages_of_documents(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, language, posterior, keep) for every row of docs.

    keep is false where no language is accepted: a null, empty or letterless text, or one of digits with no three bytes
    free of them (language 'und', posterior 0), a text in none of the languages ('und'), or a best posterior under LEAST. A null lang or source is a value of its own; null
    doc_ids and repeated rows are judged like others. Whole texts count. Further columns are ignored; no rows give none.
    """
    judged = identify(document_evidence(docs.select("doc_id", "text", "lang", "source")), ["doc_id"], **parameters)
    return judged.select("doc_id", F.col("__language").alias("language"), F.round("__posterior", 6).alias("posterior"), F.col("__accepted").alias("keep"))


def languages_of_pages(pages: DataFrame, **parameters) -> DataFrame:
    """(page_id, language, posterior, keep) for every row of pages, as languages_of_documents() with all evidence.

    A null or odd url has an empty host, domain and suffix; html that declares no language has an empty declaration.
    """
    judged = identify(page_evidence(pages), ["page_id"], **parameters)
    return judged.select("page_id", F.col("__language").alias("language"), F.round("__posterior", 6).alias("posterior"), F.col("__accepted").alias("keep"))


def keep_identified(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose language is accepted, with all columns of docs, whatever their names.

    Rows are carried whole beside their evidence, so that texts are scored once and no join moves them unless the hosts
    are too many to broadcast.
    """
    tuck, back = tucked(docs)
    text_at = f"in_{docs.columns.index('text')}"
    held = document_evidence(docs.select(*tuck, "text", "lang", "source")).drop("lang", "source")
    judged = identify(held.drop(text_at), [*[c for c in held.columns if c.startswith("in_") and c != text_at], "text"], **parameters).filter("__accepted")
    return judged.withColumn(text_at, F.col("text")).select(back)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of_documents(table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op2_language_id": op2_language_id, "language_of_pages": language_of_pages}
ORACLES: dict[str, str] = {}
