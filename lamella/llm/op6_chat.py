"""Chat formatting from a declarative template: a state machine over roles, and text segments with loss flags. DataFrame functions only.

TEMPLATE gives each role its opening and closing mark and whether its text counts for the loss; roles that it does not know get
ANY, which spells the role out. Inside texts every backslash is doubled and every mark gets a backslash after its first
character, so marks in the output are the template's alone, and taking one backslash before each character away gives the text
back. TURNS is the state machine: which role may follow which; a conversation whose turns break the order is formatted all
the same, `valid` says so.

A null text or role counts as empty. Turns are ordered by turn, role, text (nulls first), so repeated rows stay. Rows with a null conv_id form
one conversation. A conversation is one row of the result and so has to fit into one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: opening mark, closing mark, does its text count for the loss.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role: before the role, between role and text, after the text.
ANY = ("<|role|>", "<|text|>", "<|end|>")
#: State (the last role) and the roles that may come next.
TURNS = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
MARKS = tuple(m for role in TEMPLATE.values() for m in role[:2]) + ANY
ESC = "\\"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC), F.lit(ESC * 2))
    for m in MARKS:
        out = F.replace(out, F.lit(m), F.lit(m[0] + ESC + m[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in mark)


def valid(roles: Column) -> Column:
    """Run the state machine over an array of roles."""
    steps = F.create_map(*[F.lit(x) for state, nexts in TURNS.items() for role in nexts for x in (f"{state}>{role}", role)])
    end = F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit(">"), role)), F.lit("broken")))
    return ~end.isin("broken", "start")


def _by_role(role: Column, part: int, other: Column) -> Column:
    out = None
    for name, marks in TEMPLATE.items():
        out = (F.when if out is None else out.when)(role == name, F.lit(marks[part]))
    return out.otherwise(other)


def _segments(turn: Column) -> Column:
    role, text = turn["role"], escaped(turn["text"])
    opening = _by_role(role, 0, F.concat(F.lit(ANY[0]), escaped(role), F.lit(ANY[1])))
    kinds = (opening, F.lit(False)), (text, _by_role(role, 2, F.lit(False))), (_by_role(role, 1, F.lit(ANY[2])), F.lit(False))
    return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in kinds])


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss flag; joined they give formatted), valid. `rows`: conv_id, turn, role, text."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = chats.select("conv_id", F.flatten(F.transform("turns", _segments)).alias("segments"), valid(F.transform("turns", lambda t: t["role"])).alias("valid"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_chats(formatted: DataFrame) -> DataFrame:
    """`formatted` and turns (array of role and text), read from the formatted string."""
    starts = "|".join(_quoted(marks[0]) for marks in TEMPLATE.values()) + "|" + _quoted(ANY[0])

    def turn(part: Column) -> Column:
        inner = F.substring_index(F.substr(part, F.lit(len(ANY[0]) + 1)), ANY[1], 1)
        out = F.struct(unescaped(inner).alias("role"), unescaped(F.substr(part, F.length(inner) + len(ANY[0]) + len(ANY[1]) + 1, F.length(part) - F.length(inner) - sum(map(len, ANY)))).alias("text"))
        for role, (opening, closing, _) in TEMPLATE.items():
            body = F.substr(part, F.lit(len(opening) + 1), F.length(part) - len(opening) - len(closing))
            out = F.when(part.startswith(opening), F.struct(F.lit(role).alias("role"), unescaped(body).alias("text"))).otherwise(out)
        return out

    return formatted.withColumn("turns", F.transform(F.split("formatted", f"(?={starts})"), turn))


def example(spark) -> DataFrame:
    """A conversation whose texts hold the template's own marks."""
    return spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's row per conversation, read back from the formatted output."""
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(example(conversations.sparkSession))
    read = read_chats(format_chats(rows))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lossy = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    out = read.withColumn("_lossy", lossy)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("_lossy").cast("long").alias("loss_chars"),
                      F.sha2("_lossy", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def _oracle() -> str:
    text = "replace(text, '\\', '\\\\')"
    role = "replace(role, '\\', '\\\\')"
    for m in MARKS:
        text, role = (f"replace({x}, '{m}', '{m[0]}\\{m[1:]}')" for x in (text, role))
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in TEMPLATE.items())
    lossy = ", ".join(f"'{r}'" for r, m in TEMPLATE.items() if m[2])
    steps = " OR ".join(f"(before = '{s}' AND role IN ({', '.join(repr(n) for n in nexts)}))" for s, nexts in TURNS.items())
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({lossy})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role IN ({lossy})), '')) AS loss_sha256,
  CAST(sum(length({text}) + CASE role {marks} ELSE {sum(map(len, ANY))} + length({role}) END) AS BIGINT) AS formatted_chars, bool_and({steps}) AS valid
FROM o GROUP BY conv_id
"""


ORACLE = _oracle()
