"""Chat formatting: the turns of a conversation as one training text. DataFrame functions only.

A text of the format is a sequence of blocks ``<|start|>role<|body|>text<|next|>text<|end|>\\n``: one for each run of
adjacent turns of one role, whose texts ``<|next|>`` parts. Inside roles and texts ``\\`` stands as ``\\e`` and
``<`` as ``\\l``; so no mark can stand there, and replacing ``\\l`` and then ``\\e`` gives the text back. Under the loss
mask are the texts of ``assistant`` blocks.

Defined cases: a null text or role is an empty one. Turns are ordered by (turn, role, text), a null turn first;
repeated rows are turns each. Rows with a null conv_id form one conversation. An empty table gives an empty
result. Other columns are ignored. A conversation is one output row, so its turns meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.llm.common import let

START, BODY, NEXT, END = "<|start|>", "<|body|>", "<|next|>", "<|end|>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"))
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _pieces(turns: Column) -> Column:
    """Of the sorted turns, each one's share of the format: a block is opened where the role changes, and closed
    before the next change."""
    role = lambda j: F.get(turns, j)["role"]
    opens = lambda t, j: (j == 0) | (role(F.greatest(j - 1, F.lit(0))) != t["role"])
    closes = lambda t, j: (j == F.size(turns) - 1) | F.coalesce(role(j + 1) != t["role"], F.lit(True))
    return F.transform(
        turns,
        lambda t, j: F.concat(
            F.when(opens(t, j), F.concat(F.lit(START), escape(t["role"]), F.lit(BODY))).otherwise(F.lit(NEXT)),
            escape(t["text"]),
            F.when(closes(t, j), F.lit(END)).otherwise(F.lit("")),
        ),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` from ``turns (conv_id, turn, role, text)``."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = F.sort_array(F.collect_list(F.struct(F.col("turn"), text("role"), text("text"))))
    return turns.groupBy("conv_id").agg(rows.alias("_t")).select(
        "conv_id", let(F.col("_t"), lambda t: F.array_join(_pieces(t), "")).alias("formatted")
    )


def parse_chat(formatted: Column) -> Column:
    """The turns back from the format: an array of ``role, text``."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")
    head = lambda b: F.substring_index(b, BODY, 1)
    texts = lambda b: F.split(F.substring_index(b, BODY, -1), r"<\|next\|>")
    of_block = lambda b: let(
        unescape(F.replace(head(b), F.lit(START), F.lit(""))),
        lambda r: F.transform(texts(b), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))),
    )
    return F.flatten(F.transform(blocks, of_block))


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of what ``formatted`` holds, read back from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    of_turns = lambda t: F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = lambda t: F.array_join(F.transform(F.filter(t, lambda x: x["role"] == LOSS_ROLE), lambda x: x["text"]), "")
    digest = lambda t: let(
        loss(t),
        lambda under: F.struct(
            F.size(t).cast("long").alias("n_turns"), sha(of_turns(t)).alias("turns_sha256"),
            F.length(under).cast("long").alias("loss_chars"), sha(under).alias("loss_sha256"),
        ),
    )
    return chats.select(
        "conv_id", let(parse_chat(F.col("formatted")), digest).alias("d"), F.length("formatted").cast("long").alias("formatted_chars")
    ).select("conv_id", "d.*", "formatted_chars")
