"""Conversation histories. history: conv_id, turn, role, text (or parts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import has_kind, normalized_parts, part_field, part_texts, text_of, text_part
from ..functions.text import strip

#: Fixed marks that a reconstructed message begins with.
RECON_TAGS = ("[RECON_ENTRY #", "[RECON_ENTRIES]")
#: Fixed mark of a summary.
SUMMARY_MARK = "[WORK SUMMARY]"
#: Fixed words of the prompts.
TRANSLATE_MARK, ENTRIES_MARK, CAUTION_MARK, INSTRUCTION_MARK = "번역할 자막들:", "Entries:", "\n주의사항", "다음 자막들을"


def estimate_tokens(text: Column) -> Column:
    """Of stripped text: a quarter of its length or its words, whichever is more, and at least 1; empty: 0."""
    s = strip(F.coalesce(text, F.lit("")))
    words = F.size(F.split(s, r"(?U)\s+"))
    return F.when(s == "", F.lit(0)).otherwise(F.greatest(F.floor(F.length(s) / 4).cast("int"), words, F.lit(1)))


def message_tokens(history: DataFrame) -> DataFrame:
    """Of each message: the estimate of its text, or of all its parts as they are shown, and 4."""
    if "parts" in history.columns:
        each = F.transform(part_texts(F.col("parts")), estimate_tokens)
        return history.withColumn("tokens", F.aggregate(each, F.lit(4), lambda a, x: a + x))
    return history.withColumn("tokens", estimate_tokens(F.col("text")) + 4)


def history_tokens(history: DataFrame) -> DataFrame:
    return message_tokens(history).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))


def _dump(history: DataFrame) -> DataFrame:
    block = F.concat(F.upper("role"), F.lit(":\n"), strip(F.col("text")))
    said = history.where(strip(F.coalesce("text", F.lit(""))) != "")
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["b"]), DUMP_SEPARATOR).alias("dump"))


def conversation_dump(history: DataFrame) -> DataFrame:
    return _dump(history)


def _back(history: DataFrame) -> DataFrame:
    return history.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))


#: What stands between the messages of a dump; fixed text.
DUMP_SEPARATOR = "\n\n---\n\n"


def compact_history(history: DataFrame, keep: int, limit: int = 0, upcoming: int = 0, summarise: Callable[[Column], Column] = lambda dump: dump, rounds: int = 3) -> DataFrame:
    """Histories whose estimate with ``upcoming`` is above the limit: older messages give way to a summary row (turn null).

    Round r keeps the last 2 * max(0, keep - r) messages behind a summary of all that went before, the summary of the round before
    included, until the estimate fits, at most ``rounds`` times.  A history stays as it is if it fits, if it has no
    more messages than would be kept, or if what would go is blank.  ``summarise`` makes the summary's text from the dump of what goes
    (a model's reply is a column that the caller brings); the default takes the dump itself.  limit 0: one round, whatever the estimate.
    """
    if not limit:
        rounds = 1
    kept = [2 * max(0, keep - r) for r in range(rounds)]
    block = F.concat(F.upper("role"), F.lit(":\n"), strip(F.col("text")))
    said = strip(F.coalesce("text", F.lit(""))) != ""
    numbered = message_tokens(_back(history))

    def dumped(goes: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(goes & said, F.struct("turn", block.alias("b")))))
        return F.array_join(F.transform(rows, lambda r: r["b"]), DUMP_SEPARATOR)

    goes = [F.col("back") > kept[0], *((F.col("back") <= kept[r - 1]) & (F.col("back") > kept[r]) for r in range(1, rounds))]
    measures = [x for r in range(rounds) for x in (dumped(goes[r]).alias(f"d{r}"), F.sum(F.when(F.col("back") <= kept[r], F.col("tokens")).otherwise(0)).alias(f"t{r}"))]
    at = numbered.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), *measures)
    for r in range(rounds):
        dump = F.col(f"d{r}") if r == 0 else F.concat_ws(DUMP_SEPARATOR, F.concat(F.lit("MODEL:\n"), strip(F.col(f"s{r - 1}"))), F.nullif(F.col(f"d{r}"), F.lit("")))
        at = at.withColumn(f"s{r}", F.concat(F.lit(SUMMARY_MARK + "\n"), summarise(dump)))
        at = at.withColumn(f"fits{r}", (estimate_tokens(F.col(f"s{r}")) + 4 + F.col(f"t{r}") + upcoming <= limit) if limit else F.lit(True))
    stays = (F.col("n") <= kept[0]) | (F.col("d0") == "")
    if limit:
        stays |= F.col("total") + upcoming <= limit
    chosen = F.lit(rounds - 1)
    for r in reversed(range(rounds - 1)):
        chosen = F.when(F.col(f"fits{r}"), F.lit(r)).otherwise(chosen)
    at = at.select("conv_id", F.when(~stays, F.array(*[F.struct(F.lit(kept[r]).alias("kept"), F.col(f"s{r}").alias("text")) for r in range(rounds)])[chosen]).alias("to"))
    summary = at.where("to IS NOT NULL").select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("model").alias("role"), F.col("to.text").alias("text"))
    recent = numbered.join(at.select("conv_id", F.col("to.kept").alias("kept")), "conv_id").where("kept IS NULL OR back <= kept")
    return summary.unionByName(recent.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))


def should_snapshot(history: DataFrame, limit: int, prompt_tokens: int) -> DataFrame:
    return history_tokens(history).select("conv_id", (F.col("tokens") + prompt_tokens > limit).alias("snapshot"))


def cumulative_usage(history: DataFrame) -> DataFrame:
    """Of each reply: tokens of the history that was sent and of the reply, summed up over the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    sent = message_tokens(history).withColumn("sent", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    used = F.when(F.col("role") == "model", F.coalesce("sent", F.lit(0)) + F.col("tokens")).otherwise(0)
    out = sent.withColumn("usage", F.sum(used).over(w))
    return out.where(F.col("role") == "model").select("conv_id", "turn", "usage")


def drop_last_turn(history: DataFrame) -> DataFrame:
    n = Window.partitionBy("conv_id")
    return _back(history).withColumn("n", F.count("*").over(n)).where("n < 2 OR back > 2").select(*history.columns)


def history_prefix(history: DataFrame, turn: int, text: str) -> DataFrame:
    """Turns up to one of the user, with its text replaced; conversations where that turn isn't the user's give nothing."""
    good = history.where((F.col("turn") == turn) & (F.col("role") == "user")).select("conv_id").distinct()
    return history.where(F.col("turn") <= turn).join(good, "conv_id", "left_semi").withColumn("text", F.when(F.col("turn") == turn, F.lit(text)).otherwise(F.col("text")))


def sanitize_user_text(text: Column) -> Column:
    """Of a prompt, the custom part in front and its entries, cut at the caution; of a text with entries, those; else stripped."""
    s = strip(F.coalesce(text, F.lit("")))
    at = F.instr(s, TRANSLATE_MARK)
    before, rest = F.left(s, at - 1), F.substring(s, at + len(TRANSLATE_MARK), F.length(s))
    before = strip(F.when(F.instr(before, INSTRUCTION_MARK) > 0, F.left(before, F.instr(before, INSTRUCTION_MARK) - 1)).otherwise(before))
    entries = strip(F.when(F.instr(rest, CAUTION_MARK) > 0, F.left(rest, F.instr(rest, CAUTION_MARK) - 1)).otherwise(rest))
    sections = F.concat_ws("\n\n", F.nullif(before, F.lit("")), F.when(entries != "", F.concat(F.lit(TRANSLATE_MARK + "\n"), entries)))
    generic = F.when(F.instr(s, ENTRIES_MARK) > 0, strip(F.substring(s, F.instr(s, ENTRIES_MARK), F.length(s)))).otherwise(s)
    return F.when((at > 0) & (sections != ""), sections).otherwise(generic)


def text_messages(history: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts of a history of texts: each message has one text part."""
    return history.select("conv_id", "turn", "role", F.array(text_part(F.col("text"))).alias("parts"))


def normalize_messages(messages: DataFrame) -> DataFrame:
    """Messages with normalised parts, as the functions below take them. parts: array of JSON texts."""
    return messages.withColumn("parts", normalized_parts(F.col("parts")))


def _calls(part: Column) -> Column:
    """A part that holds a function call that isn't empty."""
    return F.coalesce(~F.get_json_object(part, "$.function_call").isin("", "{}", "[]", "0", "false"), F.lit(False))


def drop_function_calls(messages: DataFrame) -> DataFrame:
    """Messages without their calls; those that held nothing else go."""
    left = messages.withColumn("left", F.filter("parts", lambda p: ~_calls(p)))
    return left.where((F.size("left") > 0) | (F.size("parts") == 0)).withColumn("parts", F.col("left")).drop("left")


def sanitize_history(messages: DataFrame) -> DataFrame:
    """Texts (the user's sanitised, others stripped) and the model's calls and tools' responses; empty parts go, then empty messages."""
    user, model = F.col("role") == "user", F.col("role") == "model"

    def kept(p: Column) -> Column:
        text = F.when(user, sanitize_user_text(text_of(p))).otherwise(strip(text_of(p)))
        out = F.when(has_kind(p, "text"), F.when(text != "", text_part(text)))
        for kind in ("function_call", "tool_response"):
            out = out.when(model & has_kind(p, kind), F.to_json(F.struct(part_field(p, kind, "variant").alias(kind))))
        return out

    return messages.withColumn("parts", F.filter(F.transform("parts", kept), lambda p: p.isNotNull())).where(F.size("parts") > 0)


def recon_flag(messages: DataFrame) -> DataFrame:
    tagged = F.exists("parts", lambda p: F.startswith(text_of(p), F.lit(RECON_TAGS[0])) | F.startswith(text_of(p), F.lit(RECON_TAGS[1])))
    return messages.withColumn("is_recon", (F.col("role") == "model") & F.coalesce(tagged, F.lit(False)))
