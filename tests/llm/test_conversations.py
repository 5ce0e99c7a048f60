"""Chat formatting against a plain reader, conversation repair against whole label strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loupe.llm import chat_format, conv_repair, queries
from loupe.llm.conv_repair import RowClass

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", None, "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "a<", "|b", "<\\|", "<\\\\|im_next|>", "\\", "\n", "ends <|im_next|", "<<||", "émoji 😀<|im_line|>", "plain."]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def escaped(text):
    return re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text or "")


def brute_format(turns):
    """(role, text) in order -> the formatted string and the learned texts."""
    out, learned, before = "", [], None
    for role, text in turns:
        r = escaped(role).replace("\n", "<|im_line|>")
        if r == before:
            out = out.removesuffix("<|im_end|>\n") + "<|im_next|>"
        else:
            out += "<|im_start|>" + r + "\n"
        if role == "assistant":
            learned.append((len(out), len(escaped(text))))
        out += escaped(text) + "<|im_end|>\n"
        before = r
    return out, learned


def in_order(rows):
    """turns by (turn, escaped role, escaped text), nulls first."""
    return [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, escaped(x[1]).replace("\n", "<|im_line|>"), escaped(x[2])))]


def test_formats_like_a_plain_writer_and_reads_every_turn_back(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "", "a\nb", "<|im_start|>", "assistant"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(NASTY)) for c in [*range(20), None] for _ in range(rng.randint(1, 9))]
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS formatted", "2 AS turns", "3 AS runs", "4 AS segments", "'x' AS starts")
    got = chat_format.format_conversations(table)
    by_id = {r["conv_id"]: r for r in got.select("*", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()}
    assert set(by_id) == {*range(20), None}
    for c, r in by_id.items():
        turns = in_order([x[1:] for x in rows if x[0] == c])
        text, spans = brute_format(turns)
        assert r["formatted"] == text
        assert [tuple(s) for s in r["loss_spans"]] == spans
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["learned"] == [t for role, t in turns if role == "assistant"]
        assert r["n_blocks"] == text.count("<|im_start|>")


def test_long_conversations_and_texts_keep_their_spans(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"text {i} <| é" * (1 + i % 4)) for i in range(3000)] + [(2, 0, "assistant", "<|x😀" * 300_000), (2, 1, "assistant", "")]
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c in (1, 2):
        mine = [(r, t) for i, _, r, t in rows if i == c]
        learned = "".join(t for r, t in mine if r == "assistant")
        text, _ = brute_format(mine)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["formatted_chars"]) == (len(learned), sha(learned), len(text))


def test_sums_before(spark):
    for n in (0, 1, 511, 512, 513, 2000):
        row = spark.range(1).select(chat_format.sums_before(F.expr(f"slice(sequence(1L, 3000L), 1, {n})")).alias("s")).first()
        assert row["s"] == [i * (i + 1) // 2 for i in range(n)]


def test_chat_format_stays_native_and_takes_an_empty_table(spark, sf):
    found = queries.op11_chat_format(spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)
    planted = found.where("conv_id = -1").first()
    assert (planted["n_turns"], planted["loss_chars"]) == (2, len(queries.PLANTED))
    assert planted["loss_sha256"] == sha(queries.PLANTED)
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


# -- repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best_edits(classes):
    """The least (cost, labels) over whole label strings, and what the edits do, by the grammar's states alone."""
    behind = [None] * 4
    for i in range(len(classes), -1, -1):
        now = {}
        for inserted in range(4, -1, -1):
            for state in range(4):
                found = [(0, "", ())] if i == len(classes) and state in (0, 3) else []
                for c, role in (("u", "user"), ("a", "assistant")):
                    if (state, c) in AFTER and (inserted + 1, AFTER[state, c]) in now:
                        cost, labels, out = now[inserted + 1, AFTER[state, c]]
                        found.append((cost + 3, "I" + labels, ((role, ""), out)))
                if i < len(classes):
                    initial, must_go, cut = classes[i]
                    if behind[state]:
                        found.append((behind[state][0] + 4, "D" + behind[state][1], behind[state][2]))
                    for label, c, price in [] if must_go else [("K", initial, 0), ("R", "u", 3), ("R", "a", 3)]:
                        if (state, c) in AFTER and behind[AFTER[state, c]]:
                            cost, labels, out = behind[AFTER[state, c]]
                            found.append((cost + price + 3 * cut, label + labels, ((i, {"u": "user", "a": "assistant"}[c] if label == "R" else None), out)))
                if found:
                    now[inserted, state] = min(found, key=lambda f: f[:2])
        behind = [now.get((0, state)) for state in range(4)]
    cost, labels, linked = behind[0]
    out = []
    while linked:
        first, linked = linked
        out.append(first)
    return cost, labels, out


def test_cheapest_edits_are_the_least_over_whole_label_strings():
    rng = random.Random(5)
    for _ in range(500):
        classes = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        cost, edits = conv_repair.cheapest([RowClass(*c) for c in classes])
        want = best_edits(classes)
        assert (cost, "".join(label for e in edits for label, _ in e)) == want[:2]


def brute_repair(rows):
    """rows (turn, role, text) after damage, in order -> what the report says."""
    seen, classes, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        classes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, labels, out = best_edits(tuple(classes))
    turns = [t for t, _, _ in rows if t is not None]
    repaired = [f"{a}:{b}" if isinstance(a, str) else f"{b or rows[a][1]}:{rows[a][2]}" for a, b in out]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults, "illegal": illegal, "cost": cost, "audit": labels, "repaired_sha256": sha("\n".join(repaired)), "n_repaired": len(repaired)}


def brute_damage(rows):
    """(conv_id, turn, role, text) -> damaged conversations, in order."""
    out = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept = out.setdefault(c, [])
        kept += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    return out


def compare(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS pass", "'z' AS blank", "3 AS times", "4 AS copy")
    got = {r["conv_id"]: r.asDict() for r in conv_repair.report(conv_repair.damage(table)).collect()}
    want = {c: brute_repair(kept) for c, kept in brute_damage(rows).items()}
    assert {c: {k: r[k] for k in next(iter(want.values()), {})} for c, r in got.items()} == want
    return got


def test_damage_and_repair_of_all_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = compare(spark, rows)
    assert {r["conv_id"]: r["audit"] for r in queries.op12_conversation_repair(spark, sf).collect()} == {c: r["audit"] for c, r in got.items()}


def test_odd_rows_ties_and_long_conversations(spark):
    rng = random.Random(11)
    texts = ["", " ", "\t\n", None, "Yes.", "no", "Yes. \n", "a!", "ok?", "…", "x" * 200_000 + "."]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", None, "", "tool", "User"]), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 7))]
    rows += [(1000, i, rng.choice(["user", "assistant"]), f"turn {i % 700}{rng.choice(['.', ''])}") for i in range(900)]
    got = compare(spark, rows)
    assert all(GRAMMAR.fullmatch("") for _ in got)
    assert compare(spark, []) == {}


def test_conversation_of_which_nothing_is_left(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = compare(spark, [(c, 0, "user", "Hello.")]).values()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", sha(""))


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "system", "Be kind."), (1, 2, "user", "What"), (1, 2, "user", "What"), (2, 0, "user", "Q?")]
    turns = conv_repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()
    for c in (1, 2):
        kept = [(r["role"], r["text"]) for r in turns if r["conv_id"] == c and r["role"] is not None]
        assert GRAMMAR.fullmatch("".join(role[0] for role, _ in kept))
        assert [r["position"] for r in turns if r["conv_id"] == c] == list(range(sum(r["conv_id"] == c for r in turns)))
    assert [(r["edit"], r["role"], r["text"]) for r in turns if r["conv_id"] == 2] == [("K", "user", "Q?"), ("I", "assistant", "")]


def test_grammar_with_a_choice_for_edits_is_refused():
    odd = conv_repair.Acceptor(arcs=((0, "u", 0), (0, "a", 0)), finals=(0,))
    with pytest.raises(ValueError, match="more than one role"):
        conv_repair.cheapest([RowClass("u")], odd)
