"""Quality rules as weak supervision, in DataFrame functions only.

Nine rules, each on a statistic of its own, look at a document and vote good (1), bad (-1) or abstain
(0).  Documents that pass the base rule are counted by vote pattern (at most 3 ** 9 patterns);
expectation-maximisation over the patterns estimates how often each rule's votes are right on good and on
bad documents (its accuracies), and a document is kept if its posterior probability of being good
is at least ``KEEP``.  Whether a rule abstains is taken not to depend on the class, so an abstention
is no evidence.  The whole estimation is one ``aggregate`` over the array of patterns, so it runs
inside the plan.

The accuracies are free: a Beta prior of STRENGTH votes for each, in which good documents seldom get a
bad vote, tells the two classes apart at the start and weighs nothing against many documents.

Cases: null and empty texts have no words, fail the base rule and are not kept; equal texts get
equal results; without documents that pass the base rule none is kept; no documents give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, require_columns, text_key, words

RULES = ("word_length", "symbols", "letters", "alphabetic", "duplicate_lines", "capitals", "exclamations", "sentence_ends", "variety")
ROUNDS, PRIOR, STRENGTH, KEEP = 14, 0.9, 5.0, 0.5
#: Means of the accuracies' priors: votes that are right on good documents, on bad ones.
RIGHT = {"good": 0.95, "bad": 0.5}
#: Words of ASCII characters without a letter.
ODD = r"[\x21-\x40\x5B-\x60\x7B-\x7E]+"
WINDOW = 8


def repeated_words(w: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the array w.

    Windows are compared by two 64-bit hashes over the eight words' hashes.  Arrays without an
    equal pair of windows, nearly all, stop at the distinct count; for the others equal windows
    stand together after a sort, and their places give the covered length.
    """
    n = F.size(w) - (WINDOW - 1)
    hashes = F.transform(w, lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))

        def pick(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["k"] == F.get(s, j)["k"], F.lit(False))
            hits = F.filter(F.transform(s, lambda x, i: F.when(F.when(i > 0, same(i, i - 1)).otherwise(False) | same(i, i + 1), x["p"])), lambda p: p.isNotNull())
            at = F.array_sort(hits)
            return F.get(F.transform(F.array(at), lambda a: F.aggregate(F.transform(a, lambda p, i: F.when(F.get(a, i + 1).isNull(), WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(a, i + 1) - p))), F.lit(0), lambda x, y: x + y)), F.lit(0))

        return F.get(F.transform(F.array(placed), pick), F.lit(0))

    repeats = F.get(F.transform(F.array(F.get(F.transform(F.array(hashes), windows), F.lit(0))), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k))), F.lit(0))
    return F.when(n < 2, F.lit(0)).otherwise(repeats).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """documents -> doc_id and the statistics that rules look at."""
    require_columns(docs, ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("t"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(r"[a-z]")).cast("long").alias("n_small"),
        F.regexp_count("t", F.lit(r"[!]")).cast("long").alias("n_exclamations"),
        F.regexp_count("t", F.lit(r"[.?!](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ends"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(r"[^\x00-\x7F]")).cast("long").alias("n_wide"),
        F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])" + ODD + r"(?![^\x20\x09-\x0D])")).cast("long").alias("n_odd"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> Column:
    """The votes, in the order of RULES; integer comparisons only, so that any engine agrees."""
    c = F.col
    n, chars, ascii_letters = c("n_words"), c("word_chars"), c("n_capitals") + c("n_small")
    letters, some = ascii_letters + c("n_wide"), (n >= 50) & (n <= 2000)
    return F.array(
        _vote((10 * chars < 25 * n) | (chars > 13 * n), (10 * chars >= 35 * n) & (chars <= 9 * n)),
        _vote(10 * c("n_symbols") > n, 100 * c("n_symbols") <= n),
        _vote(4 * letters < 3 * chars, 10 * letters >= 9 * chars),
        _vote(5 * c("n_odd") > n, 20 * c("n_odd") <= n),
        _vote((c("n_dup_lines") >= 2) & (10 * c("n_dup_lines") > 3 * c("n_lines")), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
        _vote((ascii_letters >= 20) & (10 * c("n_capitals") > 4 * ascii_letters), (ascii_letters >= 20) & (10 * c("n_capitals") <= 2 * ascii_letters)),
        _vote(5 * c("n_exclamations") > n, 50 * c("n_exclamations") <= n),
        _vote((n >= 60) & (c("n_ends") * 400 < n), (n >= 60) & (2 * n <= 60 * c("n_ends")) & (2 * c("n_ends") <= n)),
        _vote(some & (10 * c("n_distinct") < 2 * n), some & (10 * c("n_distinct") >= 4 * n)),
    )


def _log_odds(v: Column, m: Column, rules: int) -> Column:
    out = F.log(m["prior"] / (1 - m["prior"]))
    for j in range(rules):
        x, of = F.get(v, F.lit(j)), lambda k: F.get(m[k], F.lit(j))  # noqa: B023, E731
        out = out + F.when(x == 1, F.log(of("good") / (1 - of("bad")))).when(x == -1, F.log((1 - of("good")) / of("bad"))).otherwise(F.lit(0.0))
    return out


def _posterior(v: Column, m: Column, rules: int = len(RULES)) -> Column:
    return 1 / (1 + F.exp(-_log_odds(v, m, rules)))


def estimate(patterns: Column, rules: int = len(RULES)) -> Column:
    """patterns array<struct<v, n>> -> struct(prior, good, bad): the rules' accuracies on the classes, by ROUNDS of EM."""
    start = F.struct(F.lit(PRIOR).alias("prior"), *(F.array_repeat(F.lit(x), rules).alias(c) for c, x in RIGHT.items()))

    def total(q: Column, part) -> Column:
        return F.aggregate(q, F.lit(0.0), lambda s, x: s + part(x))

    def right(q: Column, j: int, name: str) -> Column:
        vote = 1 if name == "good" else -1
        said = lambda x, ok: F.when(ok(F.get(x["v"], F.lit(j))), x[name]).otherwise(F.lit(0.0))
        return (total(q, lambda x: said(x, lambda v: v == vote)) + STRENGTH * RIGHT[name]) / (total(q, lambda x: said(x, lambda v: v != 0)) + STRENGTH)

    def renew(q: Column) -> Column:
        good, bad = total(q, lambda x: x["good"]), total(q, lambda x: x["bad"])
        prior = (good + STRENGTH * PRIOR) / (good + bad + STRENGTH)
        return F.struct(prior.alias("prior"), *(F.array(*(right(q, j, c) for j in range(rules))).alias(c) for c in RIGHT))

    def step(m: Column, _: Column) -> Column:
        weighed = F.transform(patterns, lambda x: F.get(F.transform(F.array(_posterior(x["v"], m, rules)), lambda p: F.struct(x["v"].alias("v"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad"))), F.lit(0)))
        return F.get(F.transform(F.array(weighed), renew), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def score_rules(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, statistics, base_failed, posterior (probability of good), kept."""
    stats = statistics(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    voted = materialize(stats.withColumn("v", votes()), "votes")
    counts = voted.where("NOT base_failed").groupBy("v").agg(F.count("*").cast("double").alias("n"))
    # One row of at most 3 ** 9 patterns, sorted so that sums run in one order.
    model = counts.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns")).where(F.size("patterns") > 0)
    model = model.withColumn("m", estimate(F.col("patterns")))
    scores = model.select(F.explode(F.transform("patterns", lambda x: F.struct(x["v"].alias("v"), _posterior(x["v"], F.col("m")).alias("posterior")))).alias("s")).select("s.v", "s.posterior")
    out = voted.join(F.broadcast(scores), "v", "left")
    kept = ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= KEEP)
    return out.withColumn("kept", kept)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents, all their columns as they are, that the rules keep; each text of a repeated or null doc_id by itself."""
    key = fresh(docs, "kept_key")
    kept = score_rules(docs.select(text_key().alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, text_key() == F.col(key), "left_semi")


def oracle_sql() -> str:
    """The same in SQL: statistics by lists, EM as a chain of ROUNDS common tables."""
    k = len(RULES)
    log_odds = lambda t: f"ln({t}.prior / (1 - {t}.prior))" + "".join(f" + CASE p.v{j} WHEN 1 THEN ln({t}.good{j} / (1 - {t}.bad{j})) WHEN -1 THEN ln((1 - {t}.good{j}) / {t}.bad{j}) ELSE 0 END" for j in range(k))
    rounds = [f"e0 AS (SELECT {PRIOR}::DOUBLE AS prior, " + ", ".join(f"{x}::DOUBLE AS {c}{j}" for c, x in RIGHT.items() for j in range(k)) + ")"]
    for r in range(1, ROUNDS + 1):
        q = f"(SELECT p.*, p.n / (1 + exp(-({log_odds('e')}))) AS good, p.n * (1 - 1 / (1 + exp(-({log_odds('e')})))) AS bad FROM p, e{r - 1} e)"
        right = lambda j, c: f"(coalesce(sum({c}) FILTER (WHERE v{j} = {1 if c == 'good' else -1}), 0) + {STRENGTH * RIGHT[c]}::DOUBLE) / (coalesce(sum({c}) FILTER (WHERE v{j} <> 0), 0) + {STRENGTH}::DOUBLE) AS {c}{j}"
        rounds.append(f"e{r} AS MATERIALIZED (SELECT (sum(good) + {STRENGTH * PRIOR}::DOUBLE) / (sum(good) + sum(bad) + {STRENGTH}::DOUBLE) AS prior, {', '.join(right(j, c) for c in RIGHT for j in range(k))} FROM {q})")
    vs = ", ".join(f"v{j}" for j in range(k))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) > {WINDOW})),
dup AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW}) AS gap FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(gap, {WINDOW})) AS r FROM dup GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_small,
  length(t) - length(replace(t, '!', '')) AS n_exclamations,
  len(list_filter(w, lambda x: x[-1] IN ('.', '?', '!'))) AS n_ends, len(list_distinct(w)) AS n_distinct,
  length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS n_wide, len(list_filter(w, lambda x: regexp_full_match(x, '{ODD}'))) AS n_odd
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_capitals + n_small AS plain, n_capitals + n_small + n_wide AS letters, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
v AS (SELECT *,
  CASE WHEN 10 * word_chars < 25 * n_words OR word_chars > 13 * n_words THEN -1 WHEN 10 * word_chars >= 35 * n_words AND word_chars <= 9 * n_words THEN 1 ELSE 0 END AS v0,
  CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END AS v1,
  CASE WHEN 4 * letters < 3 * word_chars THEN -1 WHEN 10 * letters >= 9 * word_chars THEN 1 ELSE 0 END AS v2,
  CASE WHEN 5 * n_odd > n_words THEN -1 WHEN 20 * n_odd <= n_words THEN 1 ELSE 0 END AS v3,
  CASE WHEN n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN n_lines >= 3 AND n_dup_lines = 0 THEN 1 ELSE 0 END AS v4,
  CASE WHEN plain >= 20 AND 10 * n_capitals > 4 * plain THEN -1 WHEN plain >= 20 AND 10 * n_capitals <= 2 * plain THEN 1 ELSE 0 END AS v5,
  CASE WHEN 5 * n_exclamations > n_words THEN -1 WHEN 50 * n_exclamations <= n_words THEN 1 ELSE 0 END AS v6,
  CASE WHEN n_words >= 60 AND n_ends * 400 < n_words THEN -1 WHEN n_words >= 60 AND 2 * n_words <= 60 * n_ends AND 2 * n_ends <= n_words THEN 1 ELSE 0 END AS v7,
  CASE WHEN n_words BETWEEN 50 AND 2000 AND 10 * n_distinct < 2 * n_words THEN -1 WHEN n_words BETWEEN 50 AND 2000 AND 10 * n_distinct >= 4 * n_words THEN 1 ELSE 0 END AS v8 FROM b),
p AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY {vs}),
{", ".join(rounds)},
o AS (SELECT {vs}, 1 / (1 + exp(-({log_odds('e')}))) AS posterior FROM p, e{ROUNDS} e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(posterior, 0) >= {KEEP} AS kept FROM v LEFT JOIN o USING ({vs})
"""
