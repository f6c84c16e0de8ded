"""Frame detections to one row per item, and the session record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard.functions.text import SPACE, strip
from cupboard.operators.similar import connected_names
from cupboard.session import write_and_reload


def normal_form(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?U)(?:[\p{{Punct}}]|{SPACE})+", " ")
    return strip(words)


def consolidate(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per item of a session: same name, category and location after normalising.

    The spelling used is one said in the session's audio, else the most frequent, else the last in
    alphabetical order. Counting per spelling comes first, so that neither the transcript join nor
    the final grouping sees the frames of a long session.
    """
    key = ["session_id", "name_key", "category", "location_key"]
    # Equal detections of many frames become one row first, before any text is normalised.
    seen = items.groupBy("session_id", "name", "category", "condition", "location").agg(
        F.count("*").alias("n"), F.min("frame").alias("frame")
    )
    spelled = (
        seen.withColumns({"name_key": normal_form(F.col("name")), "location_key": normal_form(F.col("location"))})
        .groupBy(*key, "name")
        .agg(
            # Asked of the groups, so that the condition is not pushed down to every frame.
            F.max(F.length("name_key")).alias("key_length"),
            F.sum("n").alias("n"),
            F.min("location").alias("location"),
            F.min(F.struct("frame", "condition")).alias("first_seen"),
        )
        .filter("key_length > 0")
    )
    said = spelled.join(sessions.select("session_id", "audio_transcript"), "session_id", "left").withColumn(
        "said", F.coalesce(F.contains("audio_transcript", F.col("name")), F.lit(False))
    )
    return said.groupBy(*key).agg(
        F.max(F.struct("said", "n", "name")).getField("name").alias("name"),
        F.min("location").alias("location"),
        F.min("first_seen").getField("condition").alias("condition"),
        F.sum("n").alias("frames"),
        F.max("said").alias("from_audio"),
    ).drop("location_key")


def spoken_names(names: DataFrame, sessions: DataFrame) -> DataFrame:
    """The (session_id, name_key) of ``names`` that the session's audio says, as whole words in any case.

    ``name_key`` is a normal form. The transcript's runs of words, as long as names of the session are, are matched with
    the names as a join, so the work follows the words said and the names, not their product.
    """
    lengths = write_and_reload(
        names.select("session_id", "name_key").distinct().withColumn("n_words", F.size(F.split("name_key", " "))))
    asked = lengths.groupBy("session_id").agg(F.collect_set("n_words").alias("lengths"))  # different lengths only
    words = F.split(normal_form(F.col("audio_transcript")), " ")
    said = sessions.select("session_id", words.alias("words")).join(asked, "session_id")
    runs = said.withColumn("n_words", F.explode("lengths")).where(F.size("words") >= F.col("n_words"))
    places = F.sequence(F.lit(1), F.size("words") - F.col("n_words") + 1)
    texts = F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("words", i, F.col("n_words")), " ")))
    spoken = runs.select("session_id", F.explode(texts).alias("name_key"))
    return lengths.select("session_id", "name_key").join(spoken, ["session_id", "name_key"], "left_semi")


def consolidate_similar(items: DataFrame, sessions: DataFrame, share: str = "0.2") -> DataFrame:
    """One row per item of a session: similar names (``similar.connected_names``) of equal category and location.

    The spelling used is one whose words are said in the session's audio, else the most frequent, else the last in
    alphabetical order; ``n_names`` counts the different names that went into the row. NULL categories are one.
    Items without a session are left out.
    """
    seen = items.where("session_id IS NOT NULL").groupBy("session_id", "name", "category", "condition", "location").agg(
        F.count("*").alias("n"), F.min("frame").alias("frame"))
    keyed = seen.withColumns({
        "name_key": normal_form(F.col("name")), "location_key": normal_form(F.col("location")),
        "category_key": F.coalesce("category", F.lit("")), "category": F.col("category")})
    group = ("session_id", "category_key", "location_key")
    # Dealt out once for both groupings; equal detections are one row by now.
    spelled = keyed.repartition(*group, "name_key").groupBy(*group, "name_key", "name").agg(
        F.max(F.length("name_key")).alias("key_length"), F.sum("n").alias("n"), F.min("location").alias("location"),
        F.min("category").alias("category"), F.min(F.struct("frame", "condition")).alias("first_seen")).filter("key_length > 0")
    # Audio says a name or not, however it is spelled: what the names bring to a row is settled name by name.
    keys = write_and_reload(spelled.groupBy(*group, "name_key").agg(
        F.max(F.struct("n", "name")).alias("best"), F.sum("n").alias("n"), F.min("location").alias("location"),
        F.min("category").alias("category"), F.min("first_seen").alias("first_seen"),
    ).withColumn("id", F.monotonically_increasing_id()))
    roots = connected_names(keys.select("id", *group, F.col("name_key").alias("name")), group, share).select("id", "root")
    said = spoken_names(keys.select("session_id", "name_key"), sessions).withColumn("said", F.lit(True))
    joined = keys.join(roots, "id").join(said, ["session_id", "name_key"], "left")
    marked = joined.withColumn("said", F.coalesce("said", F.lit(False)))
    return marked.groupBy("session_id", "root").agg(
        F.max(F.struct("said", "best")).getField("best").getField("name").alias("name"),
        F.min("category").alias("category"), F.min("location").alias("location"),
        F.min("first_seen").getField("condition").alias("condition"),
        F.sum("n").alias("frames"), F.max("said").alias("from_audio"), F.count("*").alias("n_names"),
    ).drop("root")


def session_records(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Session rows as stored: counters start at zero."""
    return sessions.select(
        "video_path", "frame_count", "has_audio", "audio_transcript",
        F.lit(0).alias("items_detected"), F.lit(0).alias("items_confirmed"), as_of.alias("processed_at"),
    )
