"""Statistics at three grains, vocabulary, pruning, counts of patterns and merging of counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import numbered
from ..storage import ship

SEED_TOKENS = ["[UNK]", "[PAD]", *".!-_:='", *"0123456789"]
#: Patterns that are counted in one aggregate.
WIDE = 64
_METRICS = (("len", "len"), ("words", "words"), ("tokens", "tokens"))


def distinct_messages(df: DataFrame) -> DataFrame:
    """Of messages with one id in a conversation the last stays. Only conversations that repeat an id pay for it."""
    ids = F.transform("messages", lambda m: m["id"])
    last = F.filter("messages", lambda m, i: ~F.array_contains(F.slice(ids, i + 2, F.size(ids)), m["id"]))
    return df.withColumn("messages", F.when(F.size(F.array_distinct(ids)) == F.size(ids), F.col("messages")).otherwise(last))


def message_stats(df: DataFrame, pattern: str = T.WORD_TOKENS) -> DataFrame:
    """conversation_seq, id, pos, message_id, len (UTF-16), words, tokens of every message."""
    x = df.select("conversation_seq", "id", F.posexplode("messages").alias("pos", "m"))
    v = F.col("m.value")
    return x.select("conversation_seq", "id", "pos", F.col("m.id").alias("message_id"), T.utf16_length(v).alias("len"), T.words(v).alias("words"), T.token_count(v, pattern).alias("tokens"))


def _aggregates(name: str, column: str) -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [
        zero(F.sum(column)).alias(f"{name}_total"), zero(F.avg(column)).alias(f"{name}_mean"), zero(F.stddev_pop(column)).alias(f"{name}_std_dev"),
        zero(F.min(column)).alias(f"{name}_min"), zero(F.max(column)).alias(f"{name}_max"), zero(F.median(column)).alias(f"{name}_median"), zero(F.max(column) - F.min(column)).alias(f"{name}_range"),
    ]


def conversation_stats(df: DataFrame, pattern: str = T.WORD_TOKENS, extras: dict[str, Column] | None = None) -> DataFrame:
    """Of every conversation id (the last conversation of an id counts): messages_count and, of len, words and tokens, total, mean, population
    standard deviation, min, max, median and range; zeros where there are no messages. Texts don't leave their task."""
    d = distinct_messages(df)
    v = lambda m: m["value"]
    stats = F.transform("messages", lambda m: F.struct(T.utf16_length(v(m)).alias("len"), T.words(v(m)).alias("words"), T.token_count(v(m), pattern).alias("tokens"), m["id"].alias("message_id")))
    last = d.select("conversation_seq", "id", stats.alias("s")).groupBy("id").agg(F.max_by("s", "conversation_seq").alias("s"))
    x = last.select("id", F.explode_outer("s").alias("s")).select("id", "s.*")
    columns = [a for n, c in _METRICS for a in _aggregates(n, c)]
    return x.groupBy("id").agg(F.count("len").alias("messages_count"), *columns, *(c.alias(n) for n, c in (extras or {}).items()))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row of conversation_stats' rows: totals, means, population standard deviations over all messages, least and greatest.

    Deviations are pooled from those of conversations, so messages aren't visited again.
    """
    zero = lambda c, t="double": F.coalesce(c.cast(t), F.lit(0).cast(t))
    total = F.sum("messages_count")
    out = [F.count("*").alias("conversations_total"), zero(total, "long").alias("messages_total"), zero(F.avg("messages_count")).alias("messages_count_mean")]
    for n, _ in _METRICS:
        mean = F.sum(f"{n}_total") / total
        square = F.sum((F.col(f"{n}_std_dev") ** 2 + F.col(f"{n}_mean") ** 2) * F.col("messages_count")) / total
        some = F.col("messages_count") > 0
        out += [zero(F.sum(f"{n}_total"), "long").alias(f"{n}_total"), zero(mean).alias(f"{n}_mean"), zero(F.sqrt(F.greatest(square - mean**2, F.lit(0.0)))).alias(f"{n}_std_dev")]
        out += [zero(F.min(F.when(some, F.col(f"{n}_min"))), "long").alias(f"{n}_min"), zero(F.max(F.when(some, F.col(f"{n}_max"))), "long").alias(f"{n}_max")]
    return stats.agg(*out)


def tokens(df: DataFrame, pattern: str = T.WORD_TOKENS) -> DataFrame:
    """conversation_seq, pos, tok, token: every token of every message in order."""
    x = df.select("conversation_seq", F.posexplode("messages").alias("pos", "m"))
    return x.select("conversation_seq", "pos", F.posexplode(F.regexp_extract_all("m.value", F.lit(pattern), F.lit(0))).alias("tok", "token"))


def vocabulary(df: DataFrame, pattern: str = T.WORD_TOKENS, seed: list[str] = SEED_TOKENS) -> DataFrame:
    """(token, idx): the seed tokens, then all others by first appearance."""
    seed = list(dict.fromkeys(seed))
    found = F.flatten(F.transform("messages", lambda m: F.regexp_extract_all(m["value"], F.lit(pattern), F.lit(0))))
    own = df.select("conversation_seq", F.posexplode(F.array_distinct(found)).alias("tok", "token"))  # each once, in order
    new = own.where(~F.col("token").isin(seed)) if seed else own
    # whole numbers only, so that sums are hashed and combined before the shuffle
    first = new.groupBy("token").agg(F.min_by("tok", "conversation_seq").alias("tok"), F.min("conversation_seq").alias("conversation_seq"))
    new = numbered(first, "conversation_seq", "tok", name="idx").select("token", (F.col("idx") + len(seed)).cast("long").alias("idx"))
    spark = df.sparkSession
    return spark.createDataFrame(list(zip(seed, range(len(seed)))), "token string, idx long").unionByName(new) if seed else new


def learnt(df: DataFrame, vocab: DataFrame, pattern: str = T.WORD_TOKENS) -> DataFrame:
    """(token, idx): vocab, and after it the tokens that it lacks by first appearance: encoding by the result adds what encoding by vocab would not know."""
    found = F.flatten(F.transform("messages", lambda m: F.regexp_extract_all(m["value"], F.lit(pattern), F.lit(0))))
    own = df.select("conversation_seq", F.posexplode(F.array_distinct(found)).alias("tok", "token"))
    first = own.groupBy("token").agg(F.min_by("tok", "conversation_seq").alias("tok"), F.min("conversation_seq").alias("conversation_seq"))
    new = numbered(first.join(vocab.select("token"), "token", "left_anti"), "conversation_seq", "tok", name="n")
    next_ = vocab.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("next"))
    new = new.join(F.broadcast(next_), how="cross").select("token", (F.col("n") + F.col("next")).cast("long").alias("idx"))  # one row
    return vocab.select("token", "idx").unionByName(new)


def spread(values: Column) -> Column:
    """Sample standard deviation of an array of numbers; 0 of fewer than two."""
    n = F.size(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    mean = total(values) / n
    return F.when(n > 1, F.sqrt(total(F.transform(values, lambda x: (x - mean) * (x - mean))) / (n - 1))).otherwise(F.lit(0.0))


def encoded(df: DataFrame, vocab: DataFrame, pattern: str = T.WORD_TOKENS) -> DataFrame:
    """conversation_seq, id, pos, codes: every message as an array of words (parts between spaces), each an array of token indices; 0 where unknown.

    A join on the token, so that the vocabulary may be of any size.
    """
    x = df.select("conversation_seq", "id", F.posexplode("messages").alias("pos", "m"))
    w = x.select("conversation_seq", "id", "pos", F.posexplode(F.split("m.value", " ", -1)).alias("word", "w"))
    t = w.select("conversation_seq", "id", "pos", "word", F.posexplode_outer(F.regexp_extract_all("w", F.lit(pattern), F.lit(0))).alias("tok", "token"))
    j = t.join(vocab.select("token", "idx"), "token", "left").withColumn("idx", F.when(F.col("token").isNotNull(), F.coalesce("idx", F.lit(0))))
    by_word = j.groupBy("conversation_seq", "id", "pos", "word").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("tok", "idx")))), lambda s: s["idx"]).alias("codes"))
    return by_word.groupBy("conversation_seq", "id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "codes"))), lambda s: s["codes"]).alias("codes"))


def decoded(codes: DataFrame, vocab: DataFrame) -> DataFrame:
    """conversation_seq, id, pos, value: tokens joined within words, words by spaces; an unknown index is the vocabulary's token 0."""
    w = codes.select("conversation_seq", "id", "pos", F.posexplode("codes").alias("word", "c"))
    t = w.select("conversation_seq", "id", "pos", "word", F.posexplode_outer("c").alias("tok", "idx"))
    zero = vocab.where("idx = 0").select(F.col("token").alias("_zero"))
    j = t.join(vocab.select("token", "idx"), "idx", "left").join(F.broadcast(zero), how="cross")  # one row
    j = j.withColumn("token", F.when(F.col("idx").isNotNull(), F.coalesce("token", "_zero")))
    by_word = j.groupBy("conversation_seq", "id", "pos", "word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("tok", "token")))), lambda s: s["token"]), "").alias("w"))
    return by_word.groupBy("conversation_seq", "id", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "w"))), lambda s: s["w"]), " ").alias("value"))


def stats_prune(df: DataFrame, stats: DataFrame | None = None, words_ratio_min: float | None = None, words_ratio_max: float | None = None, words_clamp_min: int | None = None, words_clamp_max: int | None = None, messages_min: int | None = None, messages_max: int | None = None, center: str | None = None) -> DataFrame:
    """Conversations whose shortest and longest messages, in words, are within bounds of the corpus, and their number of messages within the given.

    lo = max(sigma * ratio_min or 0, clamp_min or the corpus minimum); hi = min(sigma * ratio_max or the corpus maximum, clamp_max or the corpus maximum);
    center "mean" takes mean -+ sigma * ratio. Conversations without statistics are dropped.
    """
    s = conversation_stats(df) if stats is None else stats
    c = corpus_stats(s)
    low = F.lit(0.0) if words_ratio_min is None else F.col("words_std_dev") * words_ratio_min
    high = F.col("words_max").cast("double") if words_ratio_max is None else F.col("words_std_dev") * words_ratio_max
    if center == "mean":
        low = low if words_ratio_min is None else F.col("words_mean") - low
        high = high if words_ratio_max is None else F.col("words_mean") + high
    bounds = c.select(F.greatest(low, F.lit(words_clamp_min) if words_clamp_min is not None else F.col("words_min")).alias("_lo"), F.least(high, F.lit(words_clamp_max) if words_clamp_max is not None else F.col("words_max")).alias("_hi"))
    keep = s.select("id", "words_min", "words_max", "messages_count").join(F.broadcast(bounds), how="cross").where("words_min >= _lo and words_max <= _hi")  # one row
    if messages_min is not None:
        keep = keep.where(F.col("messages_count") >= messages_min)
    if messages_max is not None:
        keep = keep.where(F.col("messages_count") <= messages_max)
    return df.join(keep.select("id"), "id", "left_semi").select(*df.columns)


def count_occurrences(df: DataFrame, rows: list[list[str]], pattern_col: int = 0, regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    """(pos, pattern, occurrences) of the first row of each pattern: non-overlapping matches over all messages.

    No row is multiplied by patterns: up to WIDE are sums of their own in one aggregate, more literal ones are found by one automaton for each task,
    more regular expressions in an aggregate for each WIDE. Only sums are shuffled.
    """
    first: dict[str, int] = {}
    for i, r in enumerate(rows):
        if len(r) > pattern_col:
            first.setdefault(r[pattern_col] if case_sensitive or regex else r[pattern_col].lower(), i)
    spark = df.sparkSession
    if any(not p for p in first):
        raise ValueError("an empty pattern can't be counted")
    table = spark.createDataFrame([(i, p) for p, i in first.items()] or [], "pos int, pattern string")
    values = df.select(F.explode("messages").alias("m")).select(F.col("m.value").alias("v"))
    if not case_sensitive and not regex:
        values = values.select(F.lower("v").alias("v"))
    given = list(first.items())
    if not regex and len(given) > WIDE:
        counted = _by_automaton(values, given)
    else:
        counted = spark.createDataFrame([], "pos int, n long")
        for at in range(0, len(given), WIDE):
            some = given[at : at + WIDE]
            n = [F.regexp_count("v", F.lit(T.java_regex(p, case_sensitive=case_sensitive))) if regex else (F.length("v") - F.length(F.replace("v", F.lit(p), F.lit("")))) / len(p) for p, _ in some]
            sums = values.agg(F.array(*(F.sum(c.cast("long")) for c in n)).alias("n"))
            part = sums.select(F.explode(F.arrays_zip(F.array(*(F.lit(i) for _, i in some)).alias("pos"), F.col("n").alias("n"))).alias("x")).select("x.pos", "x.n")
            counted = part if at == 0 else counted.union(part)
    counted = counted.groupBy("pos").agg(F.sum("n").alias("n"))
    return table.join(counted, "pos", "left").select("pos", "pattern", F.coalesce("n", F.lit(0)).cast("long").alias("occurrences"))


def _by_automaton(values: DataFrame, given: list[tuple[str, int]]) -> DataFrame:
    """(pos, n): non-overlapping matches of each pattern by itself, from left to right; a row for each pattern and task."""
    ship(values.sparkSession)

    def count(batches):
        import ahocorasick

        found, total = ahocorasick.Automaton(), [0] * len(given)
        for k, (p, _) in enumerate(given):
            found.add_word(p, (k, len(p)))
        found.make_automaton()
        for b in batches:
            for v in b["v"].to_pylist():
                reach: dict[int, int] = {}
                for end, (k, n) in found.iter(v or ""):
                    if end - n + 1 > reach.get(k, -1):
                        reach[k] = end
                        total[k] += 1
        yield pa.record_batch({"pos": pa.array([i for _, i in given], pa.int32()), "n": pa.array(total, pa.int64())})

    return values.mapInArrow(count, "pos int, n long")


def occurrence_rows(counts: DataFrame, rows: list[list[str]], count_col: int = 1, minimum: int = 0) -> DataFrame:
    """(pos, cells): the given rows with their count put in at count_col, short rows padded with empty cells."""
    table = counts.sparkSession.createDataFrame([(i, [str(c) for c in r]) for i, r in enumerate(rows)], "pos int, cells array<string>")
    short = F.greatest(F.lit(count_col) - F.size("cells"), F.lit(0))
    padded = F.concat("cells", F.array_repeat(F.lit(""), short))
    put = F.concat(F.slice(padded, 1, count_col), F.array(F.col("occurrences").cast("string")), F.slice(padded, count_col + 1, F.greatest(F.size(padded) - count_col, F.lit(0)))) if count_col else F.concat(F.array(F.col("occurrences").cast("string")), padded)
    return table.join(counts.where(F.col("occurrences") >= minimum), "pos").select("pos", put.alias("cells"))


def add_column_merge(rows: DataFrame, pkey: int = 0, cols: list[int] = (1,), minimum: int = 0) -> DataFrame:
    """(pos, cells) of rows (pos, cells) by key: columns cols summed (a cell that is no whole number counts 0), the others from the first row.

    Rows whose sums are all below minimum go; the order is that of first appearance.
    """
    cell = lambda c: F.get("cells", F.lit(c))
    number = lambda c: F.coalesce(F.expr(f"try_cast(get(cells, {int(c)}) as bigint)"), F.lit(0))
    sums = [F.sum(number(c)).alias(f"s{c}") for c in cols]
    g = rows.groupBy(F.coalesce(cell(pkey), F.lit("")).alias("key")).agg(*sums, F.min("pos").alias("pos"), F.min_by("cells", "pos").alias("cells"))
    if minimum > 0 and cols:
        g = g.where(" or ".join(f"s{int(c)} >= {int(minimum)}" for c in cols))
    out = F.col("cells")
    for c in map(int, cols):
        out = F.transform(out, _put_at(c, F.col(f"s{c}").cast("string")))
    return g.select("pos", out.alias("cells"))


def _put_at(place: int, cell: Column):
    return lambda v, i: F.when(i == place, cell).otherwise(v)
