"""Inventories of files: ignore rules, classification, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import paths


def parse_rules(lines: list[str], source: str) -> list[dict]:
    """Rules from the lines of an ignore file: ``#`` in the first column is a comment, ``!`` negates, a last ``/`` means directories only."""
    rules = []
    for n, line in enumerate(lines, 1):
        pattern = line.strip()
        if not pattern or line.startswith("#"):
            continue
        negation = pattern.startswith("!")
        pattern = pattern[negation:]
        directory = pattern.endswith("/")
        pattern = pattern.rstrip("/") if directory else pattern
        if pattern:
            rules.append({"pattern": pattern, "source": source, "directory_only": directory, "negation": negation, "line": n})
    return rules


def rule_matches(rule: dict, path: Column, directory: Column) -> Column:
    """A rule that starts with a slash fits its components in order from the root; any other fits one component of the path."""
    parts = F.split(path, "/")
    pattern = rule["pattern"]
    if pattern.startswith("/"):
        globs = pattern.lstrip("/").split("/")
        hit = F.size(parts) >= len(globs)
        for i, g in enumerate(globs):
            hit = hit & F.coalesce(F.get(parts, F.lit(i)).rlike(paths.glob_regex(g)), F.lit(False))
    else:
        wanted = pattern.strip("/").split("/")
        if len(wanted) == 1:
            hit = F.exists(parts, lambda p: p.rlike(paths.glob_regex(wanted[0])))
        else:  # components in a row, anywhere
            regexes = [paths.glob_regex(g) for g in wanted]
            at = F.sequence(F.lit(0), F.size(parts) - len(wanted))
            run = F.exists(at, lambda i: _all_fit(parts, i, regexes))
            hit = F.when(F.size(parts) >= len(wanted), run).otherwise(False)
    return hit & directory if rule["directory_only"] else hit


def _all_fit(parts: Column, at: Column, regexes: list[str]) -> Column:
    hit = F.lit(True)
    for k, regex in enumerate(regexes):
        hit = hit & F.coalesce(F.get(parts, at + k).rlike(regex), F.lit(False))
    return hit


def last_match(rules: list[dict], path: Column, directory: Column) -> Column:
    """True or false by the last rule that fits (false if it negates), null if none does."""
    verdict = F.lit(None).cast("boolean")
    for rule in rules:
        verdict = F.when(rule_matches(rule, path, directory), F.lit(not rule["negation"])).otherwise(verdict)
    return verdict


def is_binary(content: Column) -> Column:
    """Whether the first 1,024 bytes have a NUL or are not UTF-8; a character that the cut divides does not count."""
    sample = F.substring(content, 1, 1024)
    nul = F.hex(sample).rlike("^(?:..)*00")
    whole = F.lit(False)
    for back in range(4):  # a cut character has at most three bytes
        whole = whole | F.is_valid_utf8(F.substring(sample, F.lit(1), F.greatest(F.length(sample) - back, F.lit(0))).cast("string"))
    valid = F.when(F.length(content) > 1024, whole).otherwise(F.is_valid_utf8(sample.cast("string")))
    return nul | ~valid


def ignore_verdict(items: DataFrame, user_rules: list[dict] | None = None, built_in: list[str] | None = None, content: str | None = None) -> DataFrame:
    """``items`` (relative_path, is_directory) with ``ignored`` and ``reason``: user, built_in, binary, or null.

    A user's rule decides either way, the last that fits; then built-in names only ignore; then binary content does, if
    a column with the bytes is named. All rules become one projection; nothing is joined.
    """
    path, directory = F.col("relative_path"), F.col("is_directory")
    user = last_match(user_rules or [], path, directory)
    names = built_in if built_in is not None else schemas.IGNORED
    own = last_match([r for n in names for r in parse_rules([n], "built_in")], path, directory)
    binary = is_binary(F.col(content)) & ~directory if content else F.lit(False)
    reason = F.when(user, "user").when(~user, None).when(own, "built_in").when(binary, "binary")
    df = items.withColumn("__reason", reason)
    return df.withColumns({"ignored": F.col("__reason").isNotNull(), "reason": F.col("__reason")}).drop("__reason")


def classify(items: DataFrame) -> DataFrame:
    """``items`` (relative_path, is_directory) with type, category, extension, parent_directory and stable id."""
    path = F.col("relative_path")
    df = items.withColumns({"id": paths.stable_id(path), "type": paths.type_of(path, F.col("is_directory")), "parent_directory": paths.parent_of(path)})
    extension = F.when(F.col("is_directory"), "").otherwise(F.ltrim(paths.suffix_of(path), F.lit(".")))
    return df.withColumns({"category": paths.category_of(F.col("type")), "extension": extension})


def with_hash(scanned: DataFrame, previous: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """Files of ``scanned`` with ``hash``: the previous one where size and time are unchanged, else the one in ``hashed``, if given.

    ``need_hash`` marks the files whose bytes must be read, so that unchanged files are never opened.
    """
    old = previous.select("relative_path", F.col("hash").alias("__h"), F.col("size").alias("__s"), F.col("modified_time").alias("__t"))
    same = (F.col("size") == F.col("__s")) & (F.col("modified_time") == F.col("__t")) & F.col("__h").isNotNull()
    df = scanned.drop("hash").join(old, "relative_path", "left").withColumn("need_hash", ~F.coalesce(same, F.lit(False)))
    df = df.withColumn("hash", F.when(~F.col("need_hash"), F.col("__h"))).drop("__h", "__s", "__t")
    if hashed is None:
        return df
    new = hashed.select("relative_path", F.col("hash").alias("__new"))
    return df.join(new, "relative_path", "left").withColumn("hash", F.coalesce("hash", "__new")).drop("__new")


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, previous_path, status): every path of both snapshots once, deleted or renamed ones under their new path only.

    A path in both is unchanged or modified, by hash, or by size where neither side has a hash. Of paths in one only, the
    k-th new one and the k-th vanished one of equal hash (of equal size, without hashes) are a rename, in the order of
    ``scan_seq``. Needs relative_path, hash, size, scan_seq. One full outer join, then ranks and a join by content.
    Ranks are per content; a content that very many vanished files share is sorted in one task.
    """
    p = previous.select("relative_path", F.col("hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("scan_seq").alias("old_seq"), F.lit(True).alias("was"))
    c = current.select("relative_path", "hash", "size", "scan_seq", F.lit(True).alias("is_now"))
    both = c.join(p, "relative_path", "full_outer")
    same = F.when(F.col("hash").isNotNull() & F.col("old_hash").isNotNull(), F.col("hash") == F.col("old_hash")).when(F.col("hash").isNull() & F.col("old_hash").isNull(), F.col("size") == F.col("old_size")).otherwise(False)
    kept = both.filter("was AND is_now").select("relative_path", F.lit(None).cast("string").alias("previous_path"), F.when(same, "unchanged").otherwise("modified").alias("status"))
    key = lambda h, s: F.coalesce(F.concat(F.lit("h"), h), F.concat(F.lit("s"), s.cast("string")))
    rank = lambda seq: F.row_number().over(Window.partitionBy("k").orderBy(seq, "relative_path"))
    new = both.filter("was IS NULL").select("relative_path", key(F.col("hash"), F.col("size")).alias("k"), "scan_seq").withColumn("n", rank("scan_seq"))
    gone = both.filter("is_now IS NULL").select("relative_path", key(F.col("old_hash"), F.col("old_size")).alias("k"), "old_seq").withColumn("n", rank("old_seq")).select("k", "n", F.col("relative_path").alias("old_path"))
    moved = new.join(gone, ["k", "n"], "full_outer")
    status = F.when(F.col("old_path").isNull(), "new").when(F.col("relative_path").isNull(), "deleted").otherwise("renamed")
    changed = moved.select(F.coalesce("relative_path", "old_path").alias("relative_path"), F.when(F.col("relative_path").isNotNull(), F.col("old_path")).alias("previous_path"), status.alias("status"))
    return kept.unionByName(changed)


def change_tallies(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a relation, in the order in which they apply."""
    schema = "pattern STRING, source STRING, directory_only BOOLEAN, negation BOOLEAN, line INT, seq INT"
    return spark.createDataFrame([(*(r[k] for k in ("pattern", "source", "directory_only", "negation", "line")), i) for i, r in enumerate(rules)], schema)
