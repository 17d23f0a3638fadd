"""Translation as a plan: who supplies each block, what is called, what is stored, and how a document ends.

Sources are disjoint DataFrames, so the provider's partition function runs on the rest alone: retained, then resumed,
then cached, then called. Results are written before they are checked, so a retried task repeats no call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.tokens import protect_changing, restore, restore_and_scan
from ..schemas import CHECK, EXPLANATION, RETAINED_TYPES
from .verify import NO_ERRORS, as_check, check_of, demo_check, failed_check, flag_unchanged

DEMO_PREFIX = "[offline demo: the source follows, not a translation]\n"
NONE = "array<string>"


def protected(blocks: DataFrame) -> DataFrame:
    """Adds protected_text and items."""
    return blocks.withColumn("_p", protect_changing("text")).withColumn("protected_text", F.coalesce("_p.text", "text", F.lit(""))).withColumn("items", F.col("_p.items")).drop("_p")


def retained(block_type: Column) -> Column:
    return block_type.isin(*RETAINED_TYPES)


def validate_previous(document: dict, previous: dict | None, retry: str, demo: bool = False) -> None:
    """Raises ValueError unless a run may build on the previous one. Both: document_id, target_language, model, mode."""
    if retry not in ("none", "failed", "risky", "all"):
        raise ValueError(f"unknown retry mode: {retry}")
    if previous is None:
        if retry != "none":
            raise ValueError("a retry mode needs a previous run")
        return
    if retry == "none" or demo:
        raise ValueError("a previous run needs a retry mode, and no demo")
    for name in ("document_id", "target_language", "model"):
        if document[name] != previous[name]:
            raise ValueError(f"the previous run has another {name}")
    if previous["mode"] != "live":
        raise ValueError("only a live run can be resumed")


def resume_candidates(blocks: DataFrame, previous: DataFrame) -> DataFrame:
    """Previous blocks with the same document_id, block_id and text."""
    return blocks.join(as_old(previous), ["document_id", "block_id"]).filter(F.col("text") == F.col("old_text"))


def as_old(previous: DataFrame) -> DataFrame:
    return previous.select(*[F.col(c).alias(c if c in ("document_id", "block_id") else f"old_{c}") for c in previous.columns])


def resumable(candidates: DataFrame, retry: str) -> DataFrame:
    """Candidates that may be taken over: translated, still restoring to what was stored, and with retry risky only if they had passed."""
    if retry not in ("failed", "risky"):
        return candidates.limit(0)
    rows = candidates.filter("old_translation_status = 'translated'").withColumn("_r", restore("old_raw_translation", "old_items"))
    whole = (F.size("_r.warnings") == 0) & (F.col("_r.text") == F.col("old_translation"))
    return rows.filter(whole & (F.lit(retry == "failed") | F.coalesce("old_check.passed", F.lit(False)))).drop("_r")


def beside_old(blocks: DataFrame, old: DataFrame) -> DataFrame:
    """Adds _old, what old has for the block, or null. old: what resumable returned, its documents dealt as those of blocks are."""
    return blocks.join(old.select("document_id", "block_id", F.struct("old_text", "old_items", "old_protected_text", "old_raw_translation", "old_explanation").alias("_old")).hint("merge"), ["document_id", "block_id"], "left")


def with_old(blocks: DataFrame) -> DataFrame:
    """given and usable, as call_provider takes them: resume and the old raw translation where _old (of beside_old) has the block's text, which then has the old items, protected text and explanation."""
    rows = blocks.withColumn("_same", ~retained(F.col("block_type")) & F.coalesce(F.col("text") == F.col("_old.old_text"), F.lit(False)))
    taken = {c: F.when(F.col("_same"), F.col(f"_old.old_{c}")).otherwise(F.col(c)) for c in ("items", "protected_text")}
    new = {"explanation": F.when(F.col("_same"), F.col("_old.old_explanation")), "given": F.when(F.col("_same"), "resume"), "usable": F.when(F.col("_same"), F.col("_old.old_raw_translation"))}
    return rows.withColumns(taken | new).drop("_old", "_same")


def with_cached(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """blocks with usable: what it was for blocks that are given, else the cached answer, where it passes every check without a warning. found: document_id, block_id, cached, its documents dealt as those of blocks are."""
    rows = blocks.withColumns({c: F.lit(None).cast("string") for c in ("given", "usable") if c not in blocks.columns})
    rows = rows.join(found.hint("merge"), ["document_id", "block_id"], "left").withColumns({"_warnings": F.col("warnings"), "raw": F.when(F.col("given").isNull(), F.col("cached")), "warnings": F.array().cast(NONE)})
    done = apply_raw(rows, on=F.col("raw").isNotNull())
    clean = F.col("check.passed") & (F.size("warnings") == 0)
    return done.withColumn("usable", F.coalesce("usable", F.when(clean, F.col("raw")))).withColumn("warnings", F.col("_warnings")).drop("_warnings", "cached", "raw", "translation", "check", "translation_status")


def cache_lookup(requests: DataFrame, cache: DataFrame, schema_version: int = 1) -> DataFrame:
    """Adds cached: the raw translation stored last for the request's key; null if there is none, its version is another or it is blank. cache: key, schema_version, raw_translation and, if it has it, written (a time; entries without one are the oldest)."""
    usable = cache.filter((F.col("schema_version") == schema_version) & ~is_blank(F.col("raw_translation")))
    written = F.col("written") if "written" in cache.columns else F.lit(None).cast("timestamp")
    newest = usable.groupBy("key").agg(F.max(F.struct(written.alias("written"), "raw_translation")).alias("last")).select("key", F.col("last.raw_translation").alias("cached"))
    return requests.join(newest, "key", "left")


def precedence(block_type: Column, resumed: Column, cached_clean: Column) -> Column:
    """Who supplies a block."""
    return F.when(retained(block_type), "retained").when(resumed, "resume").when(cached_clean, "cache").otherwise("provider")


def fatal_latch(outcomes: DataFrame) -> DataFrame:
    """Adds skipped: whether an earlier call of the document ended fatally. outcomes: document_id, seq, origin, fatal. Retained and resumed blocks never skip."""
    before = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fatal = F.coalesce("fatal", F.lit(False)) & ~F.col("origin").isin("retained", "resume")
    latched = F.coalesce(F.max(fatal.cast("int")).over(before), F.lit(0)) == 1
    return outcomes.withColumn("skipped", latched & ~F.col("origin").isin("retained", "resume"))


def processing_stats(results: DataFrame) -> DataFrame:
    """A row for each document. results: document_id, origin, status, called (a provider was called, whatever came of it)."""
    return results.groupBy("document_id").agg(
        F.count_if("called").alias("provider_calls"), F.count_if(F.col("origin") == "cache").alias("cache_hits"), F.count_if(F.col("origin") == "resume").alias("resumed_blocks"),
        F.count_if(F.col("origin") == "retained").alias("retained_blocks"), F.count_if(F.col("status") == "failed").alias("failed_blocks"),
    )


def document_status(documents: DataFrame, results: DataFrame, pages: DataFrame, demo: bool = False) -> DataFrame:
    """document_id, status: failed without blocks; partial with a failed block, a failed check, or a page that is uncertain or needs OCR; else completed."""
    blocks = results.groupBy("document_id").agg(F.count("*").alias("blocks"), F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or(~F.col("passed")).alias("risky"))
    unsure = pages.groupBy("document_id").agg(F.bool_or(F.col("requires_ocr") | (F.col("layout") == "uncertain")).alias("unsure"))
    rows = documents.select("document_id").join(blocks, "document_id", "left").join(unsure, "document_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    partial = no("failed") | (no("risky") & F.lit(not demo)) | no("unsure")
    return rows.select("document_id", F.when(F.coalesce("blocks", F.lit(0)) == 0, "failed").when(partial, "partial").otherwise("completed").alias("status"))


def admitted(results: DataFrame) -> DataFrame:
    """What may enter the cache: called results that passed, on blocks without any warning, layout's included."""
    return results.filter((F.col("origin") == "provider") & F.coalesce("check.passed", F.lit(False)) & (F.size("warnings") == 0) & ~is_blank(F.col("raw"))).select("key", F.lit(1).alias("schema_version"), F.col("raw").alias("raw_translation"))


def apply_raw(blocks: DataFrame, demo: bool = False, on: Column | None = None) -> DataFrame:
    """raw to translation, warnings, check and status. blocks: text, block_type, items, raw, warnings. on: the rows to look at; others get a translation and a check that mean nothing."""
    raw, text = F.coalesce("raw", F.lit("")), F.coalesce("text", F.lit(""))
    sent = [raw, F.col("items"), text]
    rows = blocks.withColumn("_r", restore_and_scan(*(sent if on is None else [F.when(on, c) for c in sent])))
    rows = rows.withColumns({"translation": F.coalesce("_r.text", raw), "_w": F.col("_r.warnings")})
    if demo:
        done = rows.withColumn("check", demo_check())
    else:
        done = rows.withColumn("check", check_of(F.col("text"), F.col("translation"), F.col("items"), F.col("_w"), F.col("_r.found"), F.col("_r.bare")))
        done = flag_unchanged(done, "text", "translation")
    return done.withColumn("warnings", F.concat("warnings", "_w")).withColumn("translation_status", F.lit("demo" if demo else "translated")).drop("_r", "_w")


def call_provider(requests: DataFrame, make_client: Callable[[], Callable[[str, str], str]], most_chars: int = 16000, together: bool = False) -> DataFrame:
    """Adds raw, error, fatal, called and origin. requests: document_id, seq, protected_text, user (the request's JSON) and, if it has them, usable (a cached answer that passes, or null) and given (who else supplies the block, whatever comes before it: nothing is asked, and usable is the answer; or null).

    make_client runs once in each task and returns complete(text, user). Rows of a document are together and in order,
    so that behind a fatal error nothing is called and no cached answer is used. A text over most_chars is an error; it
    is never cut. together: the rows of a document are in one task already.
    """
    requests = requests.withColumns({c: F.lit(None).cast("string") for c in ("usable", "given") if c not in requests.columns})

    def ask(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from .provider import ProviderError

        complete, ended = make_client(), {}

        def outcome(doc, usable: str | None, given: str | None, text: str, user: str) -> tuple:
            if given is not None:
                return None, False, False, given, usable
            if doc in ended:
                return f"not asked for, as the provider had refused: {ended[doc]}", False, False, "provider", None
            if usable is not None:
                return None, False, False, "cache", usable
            try:
                if len(text) > most_chars:
                    raise ProviderError("the block is longer than a request may be; it isn't cut")
                return None, False, True, "provider", complete(text, user)
            except ProviderError as e:
                if e.fatal:
                    ended.clear()
                    ended[doc] = str(e)
                return str(e), e.fatal, True, "provider", None

        for batch in batches:
            out = [outcome(*row) for row in zip(*(column.to_pylist() for column in batch), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()))], names=["error", "fatal", "called", "origin", "raw"])

    ordered = (requests if together else requests.repartition("document_id")).sortWithinPartitions("document_id", "seq")
    asked = F.col("usable").isNull() & F.col("given").isNull()
    answer = F.arrow_udf(ask, "struct<error:string,fatal:boolean,called:boolean,origin:string,raw:string>").asNondeterministic()
    done = ordered.withColumn("_answer", answer("document_id", "usable", "given", F.when(asked, F.col("protected_text")), F.when(asked, F.col("user"))))
    return done.select(*[c for c in requests.columns if c not in ("usable", "given", "user")], "_answer.raw", "_answer.error", "_answer.fatal", "_answer.called", "_answer.origin")


SETTLED = ("document_id", "seq", "block_id", "block_type", "text", "items", "protected_text", "key", "raw", "translation", "check", "warnings", "translation_status", "origin", "called", "fatal", "explanation")


def settle(called: DataFrame, demo: bool = False) -> DataFrame:
    """All blocks with SETTLED's columns, then the others of called: what call_provider returned, written."""
    none = F.lit(None)
    rows = called.withColumns({c: none.cast(kind) for c, kind in (("key", "string"), ("explanation", EXPLANATION)) if c not in called.columns})
    kept, cached, failed = F.col("origin") == "retained", F.col("origin") == "cache", F.col("error").isNotNull()
    # A cached answer is used only if it has passed.
    rows = apply_raw(rows.withColumn("_own", F.col("warnings")).withColumn("warnings", F.array().cast(NONE)), demo, ~kept & ~failed)
    pick = lambda kept_, cached_, failed_, else_: F.when(kept, kept_).when(failed, failed_).when(cached, cached_).otherwise(else_)
    stays = F.array(F.concat(F.lit("RetainedOriginal: a "), "block_type", F.lit(" stays as it is")))
    rows = rows.withColumns({
        "raw": F.when(kept | failed, "").otherwise(F.col("raw")),
        "translation": pick(F.col("text"), F.col("translation"), F.lit(""), F.col("translation")),
        "check": pick(none.cast(CHECK), as_check(F.array().cast(NO_ERRORS)), failed_check("TranslationFailed", F.col("error")), F.col("check")),
        "warnings": F.concat("_own", pick(stays, F.array().cast(NONE), F.array("error"), F.col("warnings"))),
        "translation_status": pick(F.lit("retained"), F.lit("translated"), F.lit("failed"), F.col("translation_status")),
    })
    return rows.select(*SETTLED, *[c for c in called.columns if c not in (*SETTLED, "error")])


def demo_raw(protected_text: Column) -> Column:
    return F.concat(F.lit(DEMO_PREFIX), protected_text)
