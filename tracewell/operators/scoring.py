"""Explainable rules over sessions and their files, scores and confidence."""

from __future__ import annotations

import re
from datetime import timedelta
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import windows
from tracewell.operators.events import ACCESS, order_key
from tracewell.operators.sessions import joined_bits, met, numbered, tallied
from tracewell.plans.config import Thresholds, Weights
from tracewell.shared import key_filter, ranged, running, with_maybe, written

SESSION = ("case_id", "device_id", "ordinal")
LEVELS = ("NONE", "LOW", "MEDIUM", "HIGH", "CONFIRMED")
SEVERAL = "multiple_confidential_files"


def has_sensitive_extension(path: Column, weights: Weights) -> Column:
    return windows.suffix(path).isin(*[e.lower() for e in weights.sensitive_extensions]) if weights.sensitive_extensions else F.lit(False)


def in_protected_directory(path: Column, weights: Weights) -> Column:
    """Whether a protected folder's text occurs in the path, without regard to case and to the kind of slash."""
    clean = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    found = F.lit(False)
    for d in weights.protected_directories:
        found = found | clean.contains(d.replace("\\", "/").lower())
    return found


# Rules in their order, and what a finding says; {} stands for a value.
RULE_INDEX = {"activity_within_30s": 0, "activity_within_5min": 0, "sensitive_extension": 1, "protected_directory": 2, "destination_hash_match": 3, SEVERAL: 4}
SAYS = {
    "activity_within_30s": "'{path}' was accessed {seconds}s after the session started, within the 30-second window.",
    "activity_within_5min": "'{path}' was accessed {seconds}s after the session started, within the 5-minute window.",
    "sensitive_extension": "'{path}' has a sensitive extension.",
    "protected_directory": "'{path}' is located in a protected project directory.",
    "destination_hash_match": "'{path}' has a SHA-256 hash matching a file found on the destination USB.",
    SEVERAL: "{count} distinct confidential files were accessed in this session.",
    "CONFIRMED": "A cryptographic hash match was found between a source file and a file on the destination USB.",
    "HIGH": "Score {score} meets the High threshold ({limit}) and both session boundaries are backed by an observed device event, not inferred.",
    "MEDIUM": "Score {score} meets the Medium threshold ({limit}), or multiple related files were accessed shortly after insertion, consistent with staging behaviour.",
    "LOW": "Score {score} is above zero but below the Medium threshold ({limit}).",
    "NONE": "No scoring rule fired for this session.",
}


def said(name: str, **values: Column | int) -> Column:
    """The sentence of a rule or level, its values filled in."""
    parts = re.split(r"\{(\w+)\}", SAYS[name])
    return F.concat(*[(v if isinstance(v := values[p], Column) else F.lit(v)).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def own_digest(details: Column) -> Column:
    """The digest that an event's details name, in lower case; only a JSON string is one."""
    named = F.try_variant_get(F.try_parse_json(details), "$.sha256", "variant")
    return F.when(F.schema_of_variant(named) == "STRING", F.lower(F.try_variant_get(F.try_parse_json(details), "$.sha256", "string")))


def with_hash_hits(events: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """``events`` with ``hash_hit``: whether the digest in the details of a file event is in ``hashes``.

    ``hashes``: (sha256) of files found on the destination, in lower case, any number of them. A bitmap of bounded size, sent to
    the events, says which of them can't be a hit; only the others meet the table of digests. So device events, events
    without a digest and most files are not shuffled, and a digest that few events have is never one task's with theirs.
    """
    if hashes is None:
        return events.withColumn("hash_hit", F.lit(False))
    named = written(hashes.select("sha256").where("sha256 IS NOT NULL").distinct(), "destination-digests")
    own = events.withColumn("_own", F.when(F.col("event_type") == ACCESS, own_digest(F.col("details"))))
    marked = with_maybe(own, "_own", key_filter(named, "sha256"))
    met = marked.where("_maybe").join(named.select(F.col("sha256").alias("_own"), F.lit(True).alias("_hit")), "_own", "left").withColumn("hash_hit", F.coalesce("_hit", F.lit(False)))
    columns = [*events.columns, "hash_hit"]
    return marked.where("NOT _maybe").withColumn("hash_hit", F.lit(False)).select(*columns).unionByName(met.select(*columns))


def fired_rules(w: Weights) -> dict[str, tuple[Column, int]]:
    """When each rule of a single file fires, on columns file_path, offset_us and hash_hit, and its points."""
    path, offset = F.col("file_path"), F.col("offset_us")
    soon = (offset >= 0) & (offset <= 30_000_000)
    return {
        "activity_within_30s": (soon, w.activity_within_30s),
        "activity_within_5min": (~soon & (offset >= 0) & (offset <= 300_000_000), w.activity_within_5min),
        "sensitive_extension": (has_sensitive_extension(path, w), w.sensitive_extension),
        "protected_directory": (in_protected_directory(path, w), w.protected_directory),
        "destination_hash_match": (F.col("hash_hit"), w.destination_hash_match),
    }


def whole_seconds() -> Column:
    """Seconds of offset_us, which is never negative; halves of a second go to the even one."""
    return F.expr("offset_us div 1000000 + CASE WHEN offset_us % 1000000 > 500000 OR (offset_us % 1000000 = 500000 AND offset_us div 1000000 % 2 = 1) THEN 1 ELSE 0 END")


#: How long after a session's start the rules on time look.
SOON = {"activity_within_30s": timedelta(seconds=30), "activity_within_5min": timedelta(minutes=5)}
#: What a contribution says, besides its session.
SAID = "file_ord long, rule_idx long, rule string, points long, source_artifacts array<string>, explanation string"


def paths(events: DataFrame) -> DataFrame:
    """File events that name a path, which alone count."""
    return events.where((F.col("event_type") == ACCESS) & F.col("file_path").isNotNull())


def secret(weights: Weights) -> Column:
    """Whether a path is confidential, by its extension or its folder."""
    return has_sensitive_extension(F.col("file_path"), weights) | in_protected_directory(F.col("file_path"), weights)


def _as(rows: DataFrame, columns: list[str], told: dict[str, Column] | None) -> DataFrame:
    """``columns``, then what ``told`` makes of the columns of ``SAID``, or these."""
    return rows.select(*columns, *([value.alias(name) for name, value in told.items()] if told else [c.split()[0] for c in SAID.split(", ")[1:]]))


def file_contributions(
    sessions: DataFrame, events: DataFrame, weights: Weights | None = None, bucket: timedelta | None = timedelta(days=1), rules: tuple[str, ...] = tuple(RULE_INDEX), told: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per rule that a file of a session fires: the session's columns, then those of ``SAID``, or file_ord and ``told``, columns made of them.

    ``events``: with hash_hit. A file has its number in the session from its place in the case, so each pair of a session and a
    file is made once, where it is wanted, and neither sorted nor stored. What does not depend on the session is said once of
    each file: a row for each rule that it fires meets sessions, and no array is made of a pair. For the rules on time, a session only meets the files
    that soon follow its start.
    """
    wanted = {name: rule for name, rule in fired_rules(weights or Weights()).items() if name in rules}
    still, timed = ({name: rule for name, rule in wanted.items() if (name in SOON) == soon} for soon in (False, True))
    order = [order_key()[i] for i in (2, 1, 3, 5, 6, 7, 8)]
    columns = ["case_id", "timestamp_utc", "event_type", "source_artifact", "file_path", "parser_name", "parser_version", "raw_timestamp", "ingest_ord", "hash_hit"]
    own = sessions.select(*SESSION, "start_utc", "end_utc")
    placed, files = numbered(own, paths(events).select(*columns), order, bucket)
    files = files.select("case_id", "timestamp_utc", F.col("before").alias("_place"), F.array("source_artifact").alias("source_artifacts"), "file_path", "hash_hit")
    placed = sessions.join(placed.select(*SESSION, F.col("before").alias("_first")), list(SESSION)).withColumn("_until", F.col("end_utc"))
    clash = [c for c in (*files.columns, *(told or {})) if c in sessions.columns and c != "case_id"]
    kept, placed = [c for c in sessions.columns if c not in clash], placed.drop(*clash)
    seconds, made = whole_seconds(), []
    value = lambda name, points: {"rule_idx": F.lit(RULE_INDEX[name]).cast("long"), "rule": F.lit(name), "points": F.lit(points).cast("long"), "explanation": said(name, path=F.col("file_path"), seconds=seconds)}
    numbered_ = (F.col("_place") - F.col("_first") + 1).alias("file_ord")
    if still:
        fired = F.array(*[F.when(holds, F.struct(*[c.alias(n) for n, c in value(name, points).items()])) for name, (holds, points) in still.items()])
        ruled = files.select("case_id", "timestamp_utc", "_place", "source_artifacts", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("r")).select("case_id", "timestamp_utc", "_place", "source_artifacts", "r.*")
        pairs = met(placed, _as(ruled, ["case_id", "timestamp_utc", "_place"], told), bucket, until="_until")
        made.append(pairs.withColumn("file_ord", numbered_).drop("_place", "_first", "_until", "timestamp_utc", "offset_us"))
    if timed:
        longest = max(SOON[name] for name in timed)
        near = placed.withColumn("_until", F.least("end_utc", F.col("start_utc") + F.expr(f"INTERVAL '{longest / timedelta(seconds=1):.6f}' SECOND")))
        pairs = met(near, files.drop("hash_hit"), bucket and max(min(bucket, longest), timedelta(seconds=1)), until="_until").where(reduce(or_, (holds for holds, _ in timed.values())))
        # one of them holds for each pair that is left
        *most, last = [(holds, value(name, points)) for name, (holds, points) in timed.items()]
        chosen = {n: reduce(lambda rest, t: F.when(t[0], t[1][n]).otherwise(rest), reversed(most), c) for n, c in last[1].items()}
        made.append(_as(pairs.select(*kept, numbered_, "source_artifacts", *[c.alias(n) for n, c in chosen.items()]), [*kept, "file_ord"], told))
    found = reduce(DataFrame.unionByName, made) if made else _as(placed.where(F.lit(False)).withColumns({n: F.lit(None).cast(k) for n, k in (c.split() for c in SAID.split(", "))}), [*kept, "file_ord"], told)
    return found.select(*made[-1].columns) if made else found


def numbered_texts(files: DataFrame, column: str, label: str) -> DataFrame:
    """Each case's distinct texts, numbered: case_id, the text, and the word of 64 bits and the bit that stand for it. Stored."""
    known = ranged(files.select("case_id", column).distinct(), ["case_id", column], f"distinct-{label}")
    return written(running(known, ["case_id"], "part", [F.col(column)], F.lit(1).cast("long"), "at").select("case_id", column, F.expr("at div 64").alias("word"), F.expr("cast(at % 64 AS int)").alias("bit")), f"numbered-{label}")


def bits_of(files: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    return files.join(numbers, ["case_id", column]).select("case_id", "timestamp_utc", "word", F.expr("shiftleft(1L, bit)").alias("bits"))


def cited(sessions: DataFrame, events: DataFrame, weights: Weights | None = None, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """(case_id, device_id, ordinal, artifacts): the distinct source artifacts of the files of a session that fire a rule, in order; a session meets no file.

    Any file fires one soon after the start, and some do whenever they are met.
    """
    still = reduce(or_, (holds for name, (holds, _) in fired_rules(weights or Weights()).items() if name not in SOON))
    files = paths(events).where(F.col("source_artifact").isNotNull()).select("case_id", "timestamp_utc", "source_artifact", F.coalesce(still, F.lit(False)).alias("still"))
    at = numbered_texts(files, "source_artifact", "artifacts")
    own = sessions.select(*SESSION, "start_utc", "end_utc")
    soon = own.withColumn("end_utc", F.least("end_utc", F.col("start_utc") + F.expr(f"INTERVAL '{max(SOON.values()) / timedelta(seconds=1):.6f}' SECOND")))
    words = [joined_bits(asked, bits_of(some, at, "source_artifact"), bucket) for asked, some in ((own, files.where("still")), (soon, files))]
    words = words[0].unionByName(words[1]).groupBy(*SESSION, "word").agg(F.bit_or("bits").alias("bits"))
    names = at.groupBy("case_id", "word").agg(F.collect_list(F.struct("bit", "source_artifact")).alias("names"))
    found = words.join(names, ["case_id", "word"]).select(*SESSION, F.expr("transform(filter(names, x -> shiftright(bits, x.bit) & 1 = 1), x -> x.source_artifact)").alias("found"))
    return found.groupBy(*SESSION).agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("artifacts"))


def several_confidential(sessions: DataFrame, events: DataFrame, weights: Weights | None = None, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """Once per session with two or more distinct confidential paths (sensitive by extension or by folder).

    The paths of a case are numbered, and a session's are bits of 64-bit words, joined at its ends (``joined_bits``): it meets no file.
    """
    w = weights or Weights()
    files = paths(events).where(secret(w)).select("case_id", "timestamp_utc", "file_path")
    at = numbered_texts(files, "file_path", "paths")
    words = joined_bits(sessions.select(*SESSION, "start_utc", "end_utc"), bits_of(files, at, "file_path"), bucket)
    many = words.groupBy(*SESSION).agg(F.collect_list(F.struct("word", "bits")).alias("words"), F.sum(F.bit_count("bits")).alias("n")).where("n >= 2")
    names = at.groupBy("case_id", "word").agg(F.sort_array(F.collect_list(F.struct("bit", "file_path"))).alias("names"))
    known = written(sessions.join(many, list(SESSION)), "sessions-with-several")
    named = known.select(*sessions.columns, F.explode("words").alias("_w"), (F.size("words") == 1).alias("_only")).select(*sessions.columns, "_w.*", "_only").join(names, ["case_id", "word"])
    found = named.select(*sessions.columns, "_only", "word", F.expr("transform(filter(names, x -> shiftright(bits, x.bit) & 1 = 1), x -> x.file_path)").alias("found"))
    # a session whose paths are bits of one word, as all are where a case has few, is not gathered
    rest = found.where("NOT _only").groupBy(*SESSION).agg(F.flatten(F.expr("transform(sort_array(collect_list(struct(word, found))), x -> x.found)")).alias("source_artifacts"))
    cited = found.where("_only").select(*sessions.columns, F.col("found").alias("source_artifacts")).unionByName(known.where("size(words) > 1").drop("words", "n").join(rest, list(SESSION)))
    return cited.select(
        *sessions.columns, F.lit(None).cast("long").alias("file_ord"), F.lit(RULE_INDEX[SEVERAL]).cast("long").alias("rule_idx"), F.lit(SEVERAL).alias("rule"), F.lit(w.multiple_confidential_files).cast("long").alias("points"), "source_artifacts",
        said(SEVERAL, count=F.size("source_artifacts")).alias("explanation"),
    )


def contributions(
    sessions: DataFrame, events: DataFrame, weights: Weights | None = None, bucket: timedelta | None = timedelta(days=1), rules: tuple[str, ...] = tuple(RULE_INDEX), told: dict[str, Column] | None = None,
) -> DataFrame:
    """What the ``rules`` say of ``sessions``, whose columns all rows have. ``told`` as in ``file_contributions``."""
    found = []
    if rules != (SEVERAL,):
        found.append(file_contributions(sessions, events, weights, bucket, rules, told))
    if SEVERAL in rules:
        found.append(_as(several_confidential(sessions, events, weights, bucket), [*[c for c in sessions.columns if c not in (told or {})], "file_ord"], told))
    return reduce(DataFrame.unionByName, found)


def scores(sessions: DataFrame, events: DataFrame, weights: Weights | None = None, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """Every session with its total, how many contributions it has (``fired``), and whether the two rules that confidence looks at have fired (even for no points).

    ``events``: with hash_hit. All is told by sums at the ends of sessions (``tallied``), so no session meets its files.
    """
    w = weights or Weights()
    still = [(holds, points) for name, (holds, points) in fired_rules(w).items() if name not in SOON]
    one, sum_ = F.lit(1), lambda values: reduce(add, values, F.lit(0))
    sums = {f"_{name}": (one, span) for name, span in SOON.items()} | {
        "_points": (sum_(F.when(holds, F.lit(points)).otherwise(F.lit(0)) for holds, points in still), None), "_fired": (sum_(F.when(holds, one).otherwise(F.lit(0)) for holds, _ in still), None), "_hits": (F.col("hash_hit").cast("long"), None),
    }
    found = tallied(sessions, paths(events), sums, F.when(secret(w), F.col("file_path")), bucket)
    early, later = F.col("_activity_within_30s"), F.col("_activity_within_5min") - F.col("_activity_within_30s")
    extra = F.when(F.col("several"), F.lit(w.multiple_confidential_files)).otherwise(F.lit(0))
    total = early * w.activity_within_30s + later * w.activity_within_5min + F.col("_points") + extra
    return found.select(*sessions.columns, (F.col("_hits") > 0).alias("hash_hit"), "several", total.cast("long").alias("total_score"), (early + later + F.col("_fired") + F.col("several").cast("long")).alias("fired"))


def confidence(scored: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Add confidence_rank (0 to 4), confidence_level and confidence_reason."""
    t = thresholds or Thresholds()
    score = F.col("total_score")
    ladder = [
        ("CONFIRMED", F.col("hash_hit"), {}),
        ("HIGH", (score >= t.high) & F.col("fully_observed"), {"score": score, "limit": t.high}),
        ("MEDIUM", (score >= t.medium) | F.col("several"), {"score": score, "limit": t.medium}),
        ("LOW", score > 0, {"score": score, "limit": t.medium}),
    ]
    rank, reason = F.lit(0), said("NONE")
    for level, condition, values in reversed(ladder):
        rank, reason = F.when(condition, F.lit(LEVELS.index(level))).otherwise(rank), F.when(condition, said(level, **values)).otherwise(reason)
    return scored.withColumn("confidence_rank", rank.cast("long")).withColumn("confidence_level", F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("confidence_rank") + 1).cast("int"))).withColumn("confidence_reason", reason)


def findings(sessions: DataFrame, events: DataFrame, weights: Weights | None = None, thresholds: Thresholds | None = None, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """One finding per session, zero scores included."""
    return scored(sessions, events, weights, thresholds, bucket).drop("fired")


def scored(sessions: DataFrame, events: DataFrame, weights: Weights | None = None, thresholds: Thresholds | None = None, bucket: timedelta | None = timedelta(days=1)) -> DataFrame:
    """Findings, with the number of their contributions (``fired``)."""
    return confidence(scores(sessions, events, weights, bucket), thresholds)


def explained(
    sessions: DataFrame, events: DataFrame, weights: Weights | None = None, thresholds: Thresholds | None = None, bucket: timedelta | None = timedelta(days=1),
    cells: dict[str, Column] | None = None, told: dict[str, Column] | None = None,
) -> DataFrame:
    """A row for each contribution, with its finding's columns, and one with null rule columns for a finding without any.

    ``sessions`` may have more columns, which are kept. Findings are known before they meet files, so what they say is never joined to contributions.
    ``cells``: only these are kept of findings, besides the session's key and times; they are made once of each, as is ``told`` (``file_contributions``).
    """
    found = confidence(scores(sessions, events, weights, bucket), thresholds)
    if cells:
        found = found.select(*SESSION, "start_utc", "end_utc", "fired", *[value.alias(name) for name, value in cells.items() if name not in SESSION])
    found = written(found, "findings")
    # the finding's hit is set aside while the files' own is looked at
    renamed = found.withColumnRenamed("hash_hit", "_hit")
    none = renamed.where("fired = 0").select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (column.split() for column in SAID.split(", "))])
    none = _as(none, [*renamed.columns, "file_ord"], told)
    return contributions(renamed, events, weights, bucket, told=told).unionByName(none).withColumnRenamed("_hit", "hash_hit").drop("fired")
