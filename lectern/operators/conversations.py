"""Chat sessions and model responses as tables. Turns stay rows: a session may be of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .context import UNTITLED
from .scans import HOT_ROWS, prefix_scan


def append_turn(turns: DataFrame, new: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """CNV-1: (turn rows to append, positions following the session's last, and turns of unknown sessions).

    new (session_id, ord, ...): ``ord`` orders the new turns of a session.
    """
    last = turns.groupBy("session_id").agg(F.max("pos").alias("_last"))
    known = prefix_scan(new.join(last, "session_id"), ["session_id"], ["ord"], rank="_rn", hot_rows=hot_rows)
    rows = known.withColumn("pos", F.col("_last") + F.col("_rn")).drop("_last", "_rn")
    return rows, new.join(last, "session_id", "left_anti")


def sessions(turns: DataFrame) -> DataFrame:
    """CNV-2: one row per session: turns, roles, first and last time."""
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("role") == "user").alias("n_questions"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )


def delete_sessions(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """CNV-2: without the given sessions; unknown ids change nothing."""
    return turns.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def history(turns: DataFrame) -> DataFrame:
    """CNV-3: what a later prompt repeats: neither system turns nor failed ones."""
    failed = F.col("error").isNotNull() & (F.col("error") != "") if "error" in turns.columns else F.lit(False)
    return turns.filter((F.col("role") != "system") & ~failed)


def history_messages(turns: DataFrame, key: str = "query_id") -> DataFrame:
    """CNV-3 as one ordered message array per prompt (a prompt holds its history whole, by nature)."""
    listed = history(turns).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "content"))).alias("t"))
    return listed.select(key, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def question_of(turns: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """CNV-4: assistant turns with the nearest user turn before them (empty if none)."""
    asked = F.when(F.col("role") == "user", F.col("content"))
    out = prefix_scan(turns, ["session_id"], ["pos"], lasts={"question": asked}, hot_rows=hot_rows)
    return out.filter(F.col("role") == "assistant").withColumn("question", F.coalesce("question", F.lit("")))


def note_markdown(question: Column, answer: Column, notebook: Column, ts: Column, citations: Column) -> Column:
    """CNV-5: an answer as a note; ``citations`` is an array of ``schemas.CITATION`` structs."""
    asked = text.trim_ws(question)
    title = F.when(asked == "", "(no question)").otherwise(asked)
    head = F.concat(
        F.lit("# "), title, F.lit("\n\n> "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" — "), notebook, F.lit("\n\n"), answer
    )

    def entry(c: Column) -> Column:
        heading = F.when(F.coalesce(c["heading_text"], F.lit("")) == "", UNTITLED).otherwise(c["heading_text"])
        return F.concat(
            F.lit("\n\n### ["), c["index"].cast("string"), F.lit("] "), heading,
            F.lit("\n\nFrom [["), c["file_path"], F.lit("]], characters "), c["char_start"].cast("string"), F.lit(" to "), c["char_end"].cast("string"),
            F.lit("\n\n> "), c["preview"],
        )

    # the index is the struct's first field, so sorting the array sorts by it
    listed = F.array_join(F.transform(F.array_sort(citations), entry), "")
    tail = F.when(F.size(citations) > 0, F.concat(F.lit("\n\n---\n\n## Sources"), listed)).otherwise("")
    return F.concat(head, tail, F.lit("\n"))


def dedupe_names(names: DataFrame, existing: DataFrame, order: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """CNV-6: ``unique_name`` for (name, <order>): the name if free, else `` (2)``, `` (3)`` ... skipping taken ones.

    New names and taken numbers of a stem are ranked apart: the j-th new name gets the j-th free number.
    """
    stem = F.regexp_replace(F.col("name"), r"\.md\z", "")
    new = prefix_scan(names.withColumn("_stem", stem), ["_stem"], [order], rank="_rn", hot_rows=hot_rows)
    numbered = r" \((\d+)\)\z"
    number = F.regexp_extract(stem, numbered, 1)
    taken = existing.select(F.explode(F.array_compact(F.array(
        F.struct(stem.alias("_stem"), F.lit(1).cast("bigint").alias("_n")),
        F.when((number != "") & (number.try_cast("bigint") >= 2), F.struct(F.regexp_replace(stem, numbered, "").alias("_stem"), number.try_cast("bigint").alias("_n"))),
    ))).alias("t")).select("t.*").distinct()
    sizes = new.groupBy("_stem").agg(F.count(F.lit(1)).alias("_new"))
    room = sizes.join(taken.groupBy("_stem").agg(F.count(F.lit(1)).alias("_taken")), "_stem", "left")
    slots = room.select("_stem", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_new") + F.coalesce("_taken", F.lit(0)))).alias("_n"))
    free = prefix_scan(slots.join(taken, ["_stem", "_n"], "left_anti"), ["_stem"], ["_n"], rank="_rn", hot_rows=hot_rows)
    suffix = F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    ext = F.when(F.col("name").endswith(".md"), ".md").otherwise("")
    return new.join(free, ["_stem", "_rn"]).select(*names.columns, F.concat("_stem", suffix, ext).alias("unique_name"))


_USAGE = "prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT"
_FRAME = f"choices ARRAY<STRUCT<delta: STRUCT<content: STRING>>>, usage STRUCT<{_USAGE.replace(' BIGINT', ': BIGINT')}>"


def parse_frames(frames: DataFrame) -> DataFrame:
    """CNV-7 per block: (response_id, seq, delta, done, usage) of server-sent ``data:`` blocks.

    The first non-empty delta of a block is the block's event; only a block without one can end the stream.
    """
    data = F.transform(
        F.filter(F.split("block", "\n"), lambda ln: ln.startswith("data:")), lambda ln: text.trim_ws(F.substring(ln, 6, 2**31 - 1))
    )
    parsed = F.transform(data, lambda d: F.from_json(d, _FRAME))
    deltas = F.filter(F.transform(parsed, lambda p: F.get(p["choices"], F.lit(0))["delta"]["content"]), lambda c: c.isNotNull() & (c != ""))
    usages = F.filter(F.transform(parsed, lambda p: p["usage"]), lambda u: u.isNotNull())
    delta = F.get(deltas, F.lit(0))
    usage = F.when(delta.isNull() & (F.size(usages) > 0), F.try_element_at(usages, F.lit(-1)))
    done = delta.isNull() & (F.array_contains(data, "[DONE]") | (F.size(usages) > 0))
    return frames.select("response_id", "seq", delta.alias("delta"), done.alias("done"), usage.alias("usage"))


def assemble_stream(frames: DataFrame) -> DataFrame:
    """CNV-7: (response_id, content, done, total_tokens): the deltas of each response in order (one answer each)."""
    return (
        parse_frames(frames)
        .groupBy("response_id")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("seq", "delta")))).alias("d"),
            F.bool_or("done").alias("done"),
            F.max_by("usage.total_tokens", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("total_tokens"),
        )
        .select("response_id", F.array_join(F.transform("d", lambda d: d["delta"]), "").alias("content"), "done", "total_tokens")
    )


_RESPONSE = (
    "choices ARRAY<STRUCT<message: STRUCT<content: STRING, reasoning_content: STRING>>>, "
    "usage STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, total_tokens: BIGINT>"
)


def response_text(responses: DataFrame) -> DataFrame:
    """CNV-8: adds content (else the reasoning text), token usage, and an error where there is no choice."""
    r = F.from_json("body", _RESPONSE)
    message = F.get(r["choices"], F.lit(0))["message"]
    none = F.coalesce(F.size(r["choices"]), F.lit(0)) <= 0
    content = F.coalesce(F.nullif(message["content"], F.lit("")), message["reasoning_content"], F.lit(""))
    return responses.select(
        "*",
        F.when(~none, content).alias("content"),
        r["usage"]["prompt_tokens"].alias("prompt_tokens"),
        r["usage"]["completion_tokens"].alias("completion_tokens"),
        r["usage"]["total_tokens"].alias("total_tokens"),
        F.when(none, "No choices in response").alias("error"),
    )


def answer_citations(answers: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TXT-8 on tables: (marks with their citation, dangling marks) for answers (answer_id, content)."""
    marks = answers.select("answer_id", F.posexplode(text.citation_marks(F.col("content"))).alias("mark_no", "index"))
    return marks.join(citations, ["answer_id", "index"]), marks.join(citations.select("answer_id", "index"), ["answer_id", "index"], "left_anti")
