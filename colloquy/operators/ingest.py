"""Decisions around transcription: which backend, how long to wait between tries, whether a host is fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X

#: Tries of a request, the wait where a rate limit names none, the longest that is waited for, seconds added
#: to a named wait, and the step between tries after other errors.
TRIES, UNNAMED_WAIT, LONGEST_WAIT, MARGIN, STEP = 5, 180, 120, 5, 10


def transcribe_backend(choice: Column, has_key: Column, macos: Column, parakeet: Column) -> Column:
    """The backend that transcribes: the one chosen, for `auto` the first that is there; null if none is."""
    told = F.lower(X.strip(F.coalesce(choice, F.lit(""))))
    return F.when(told != "auto", told).when(has_key, "groq").when(macos & parakeet, "parakeet")


def retry_wait(limited: Column, message: Column, attempt: Column) -> Column:
    """Seconds to wait after a failed try (numbered from 0); null where it gives up at once."""
    pattern = r"in (\d+)m(\d+)s"
    named = F.regexp_extract(message, pattern, 1).try_cast("int") * 60 + F.regexp_extract(message, pattern, 2).try_cast("int") + MARGIN
    wait = F.coalesce(named, F.lit(UNNAMED_WAIT))
    return F.when(limited, F.when((wait <= LONGEST_WAIT) & (attempt < TRIES), wait)).otherwise(F.when(attempt < TRIES - 1, STEP * (attempt + 1)))


def retried(attempts: DataFrame) -> DataFrame:
    """Requests by outcome. attempts: request_id, attempt (from 0), ok, limited, message; what comes after the end doesn't count.

    request_id, tries, waited (seconds) and outcome: done, gave-up or open.
    """
    own = attempts.withColumn("_wait", F.when(~F.col("ok"), retry_wait(F.col("limited"), F.coalesce("message", F.lit("")), F.col("attempt"))))
    ends = F.min(F.when(F.col("ok") | F.col("_wait").isNull() | (F.col("attempt") >= TRIES - 1), F.col("attempt")))
    last = own.groupBy("request_id").agg(ends.alias("_end"))
    counted = own.join(last, "request_id").filter(F.col("_end").isNull() | (F.col("attempt") <= F.col("_end")))
    done = F.bool_or(F.col("ok"))
    outcome = F.when(done, "done").when(F.max("_end").isNotNull(), "gave-up").otherwise("open")
    return counted.groupBy("request_id").agg(F.count("*").alias("tries"), F.coalesce(F.sum("_wait"), F.lit(0)).cast("long").alias("waited"), outcome.alias("outcome"))


def doctor(hosts: DataFrame) -> DataFrame:
    """Hosts (host, platform, tools map<string,boolean>, has_key, parakeet, whisper) with what they lack and whether they transcribe."""
    macos = F.col("platform") == "darwin"
    missing = F.array_sort(F.map_keys(F.map_filter("tools", lambda _, there: ~there)))
    ready = F.col("has_key") | (macos & (F.col("parakeet") | F.col("whisper")))
    hint = F.when(~ready, F.when(macos, "install a local backend or set a key").otherwise("set a key"))
    return hosts.select("host", missing.alias("missing_tools"), ready.alias("audio_ready"), hint.alias("hint"))
