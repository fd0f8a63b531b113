"""The query of op9 gives what the machine over roles says."""

from quarry.llm.queries import QUERIES
from tests.conftest import SF


def test_op9_marks_conversations(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    may = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    want = {-1: (True, None)}
    for c, rows in turns.items():
        roles = [r for _, r, _ in sorted(rows)]
        broken = next((i for i, step in enumerate(zip(["", *roles], roles)) if step not in may), None)
        want[c] = (broken is None and roles[-1] == "assistant", broken)
    got = {r["conv_id"]: (r["valid"], r["broken"]) for r in QUERIES["op9_chat_format"](spark, SF).collect()}
    assert got == want
    assert {v for v, _ in got.values()} == {True, False}
