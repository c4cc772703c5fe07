"""Chat formatting by grammar round trip: rendered turns are parsed again, compared with their source, and escaped until equal.

The grammar::

    conversation = "<s>" turn*
    turn         = ["~"] body
    body         = "[INST] " text " [/INST]"                 (user)
                 | " " text "</s>"                           (assistant)
                 | "[ROLE " name "] " text " [/ROLE]"        (any other role)

A turn whose plain rendering is not read back as it was is marked ``~`` and has its control characters written as ``~0`` to
``~4``; within such a turn no control string can occur. All is done by DataFrame functions, on single turns; a conversation
is put together at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
# The characters that control strings need, and what stands for each in an escaped text.
ESCAPES = (("~", "~0"), ("[", "~1"), ("]", "~2"), ("<", "~3"), (">", "~4"))
#: What ends a turn.
ENDS = r" \[/INST\]|</s>| \[/ROLE\]"
#: What a text must not hold, and no text and what surrounds it may make, for a plain rendering to be read back.
CONTROL = r"</?s>|\[/?INST\]|\[ROLE |\[/ROLE\]"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def rendered(role: Column, text: Column, hard: Column) -> Column:
    """A turn; ``hard``: escaped."""
    name, body = F.when(hard, escaped(role)).otherwise(role), F.when(hard, escaped(text)).otherwise(text)
    turn = F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]"))).when(role == "assistant", F.concat(F.lit(" "), body, F.lit("</s>")))
    return F.concat(F.when(hard, F.lit("~")).otherwise(F.lit("")), turn.otherwise(F.concat(F.lit("[ROLE "), name, F.lit("] "), body, F.lit(" [/ROLE]"))))


def parsed(turn: Column) -> Column:
    """struct(role, text, n) of a rendered turn, read by the grammar alone; n: how many turns it holds."""
    hard = F.substring(turn, 1, 1) == "~"
    body = F.when(hard, F.substr(turn, F.lit(2))).otherwise(turn)
    user, assistant = F.startswith(body, F.lit("[INST] ")), F.startswith(body, F.lit(" "))
    tail = F.when(user, F.length(F.lit(" [/INST]"))).when(assistant, F.length(F.lit("</s>"))).otherwise(F.length(F.lit(" [/ROLE]")))
    head = F.when(user, F.length(F.lit("[INST] "))).when(assistant, F.lit(1)).otherwise(F.instr(body, "] ") + 1)
    name = F.substr(body, F.lit(7), F.greatest(F.instr(body, "] ") - 7, F.lit(0)))
    text = F.substr(body, head + 1, F.greatest(F.length(body) - head - tail, F.lit(0)))
    role = F.when(user, F.lit("user")).when(assistant, F.lit("assistant")).otherwise(F.when(hard, unescaped(name)).otherwise(name))
    # The text's own end is the only one, and nothing in it begins a turn.
    inner = F.regexp_count(text, F.lit(CONTROL))
    return F.struct(role.alias("role"), F.when(hard, unescaped(text)).otherwise(text).alias("text"), (F.regexp_count(body, F.lit(ENDS)) + inner).alias("n"))


def _checked(turn: Column, role: Column, text: Column) -> Column:
    """The escaped turn, which is parsed and compared as well."""
    back = parsed(turn)
    return F.when((back["role"] == role) & (back["text"] == text) & (back["n"] == 1), turn).otherwise(F.raise_error(F.lit("an escaped turn is not read back")).cast("string"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, hard, rendered) for each row of ``turns`` (conv_id, turn, role, text; others are ignored).

    A plain rendering stands where parsing it gives role and text back and finds one turn; else the turn is escaped, which
    always does. A null role or text counts as empty.
    """
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tried = base.withColumn("plain", rendered(F.col("role"), F.col("text"), F.lit(False)))
    back = parsed(F.col("plain"))
    return tried.withColumn("back", back).withColumn("hard", ~((F.col("back.role") == F.col("role")) & (F.col("back.text") == F.col("text")) & (F.col("back.n") == 1) & ~F.startswith("plain", F.lit("~")))).select(
        "conv_id", "turn", "role", "text", "hard", F.when(F.col("hard"), _checked(rendered(F.col("role"), F.col("text"), F.lit(True)), F.col("role"), F.col("text"))).otherwise(F.col("plain")).alias("rendered")
    )


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one text for each conversation, its turns in order of turn, then role, then text.

    Repeated rows are turns of their own; a null turn number comes first; rows with a null conv_id are one conversation. No
    rows give no rows.
    """
    made = formatted(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("t"))
    return made.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform("t", lambda x: x["rendered"]), "")).alias("formatted"))


def read_back(texts: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted): ``conversations`` parsed by the grammar into an array of struct(role, text, n)."""
    # Each turn ends with an end string; a text never holds one.
    pieces = F.regexp_extract_all(F.substr("formatted", F.lit(len(BEGIN) + 1)), F.lit(rf"(?s)(.*?(?:{ENDS}))"), F.lit(1))
    return texts.select("conv_id", F.transform(pieces, parsed).alias("turns"), "formatted")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted text.

    Under the loss mask are the texts of assistant turns alone.
    """
    back = read_back(conversations(turns))
    all_, loss = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )
