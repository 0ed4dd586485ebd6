"""Chat formatting (exact round trips) and language identification (held-out accuracy)."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetext.llm import chat, langid

NASTY = st.lists(st.sampled_from(["<", "[", "\\", "|turn|>", "|end|>", "/s>", "s>", "INST]", "/INST]", "|image|>", "\n", "a", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(NASTY, NASTY)
def test_escapes(text, role):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not chat._CONTROL.search(e.replace("\\", "")) or chat.unescape(e) == text
    for c in ("<|turn|>", "<|end|>", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]"):
        assert c not in e
    s = chat.render([{"type": "text", "text": text, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}], role)
    assert chat.parse_segment(s["segment"]) == (role, text)


def test_parts(spark):
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part("text", text="see <|image|> "), part("image", ref="a.png", width=56, height=30), part("audio", ref="b.wav", seconds=2.0), None, part("document", ref="c.pdf", pages=3), part("odd", text="?")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("text", text="ok")]), (2, None, None, None)], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    rows = {(r.conv_id, r.turn): r for r in chat.format_turns(df).collect()}
    r = rows[1, 0]
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 1536)] and r.n_tokens_media == 1590
    for a in r.attachments:
        assert r.segment[a.position :].startswith(chat.PLACEHOLDERS[a.kind])
    assert r.loss_start is None and rows[1, 1].segment[rows[1, 1].loss_start : rows[1, 1].loss_end] == "ok"
    assert rows[2, None].segment == "<|turn|>\n<|end|>\n"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out[conv] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_round_trip(spark, sf):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "[INST] <s> \\ é🙂"), (1, 1, "assistant", "[INST] <s> \\ é🙂"), (2, 0, None, None), (None, 5, "assistant", ""), (3, None, "tool\nx", "a"), (3, 2, "assistant", "b" * 70000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as segment", "2 as key")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == brute(rows)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    out = chat.op4_chat_formatting(spark, sf)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == brute(turns)


def test_filter_against_exact_sets(spark):
    """Kept n-grams by brute force: the filter holds all of them, and as many others as the measured rate tells."""
    rng = np.random.default_rng(0)
    counts = {(f"l{k:02}", int(g)): int(rng.integers(1, 40)) for k in range(70) for g in rng.integers(0, 3000, 900)}
    m = langid.Model.fit(spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "lang string, gram bigint, n bigint"))
    assert m.slots.shape[0] == 2 and len(m.langs) == 70
    total, best = {}, {}
    for (lang, _), n in counts.items():
        total[lang] = total.get(lang, 0) + n
    for (lang, g), n in counts.items():
        best[g] = max(best.get(g, 0), n / total[lang])
    keep = {(lang, g) for (lang, g), n in counts.items() if n >= 3 and n / total[lang] >= 0.5 * best[g] - 1e-15}
    grams = np.array(sorted(best), np.uint64)
    masks = m.masks(grams)
    got = {(m.langs[k], int(g)) for k in range(70) for g in grams[(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) > 0]}
    assert keep <= got
    others = 70 * len(grams) - len(keep)
    assert abs(len(got - keep) - m.rate.mean() * others) <= 0.002 * others


def test_false_positives_of_a_full_filter():
    """The measured rate is that of keys which the filter lacks."""
    rng = np.random.default_rng(1)
    slots = np.zeros((1, 1 << 12), np.uint64)
    known = rng.choice(1 << 32, 1500, replace=False).astype(np.uint64)
    slots[0, langid.places(known, 1 << 12).ravel()] |= np.uint64(1)
    m = langid.Model(["x"], slots, "x")
    new = np.setdiff1d(rng.choice(1 << 32, 50_000).astype(np.uint64), known)
    assert m.masks(known).all() and m.rate[0] > 0.1 and abs(np.count_nonzero(m.masks(new)) / len(new) - m.rate[0]) < 0.01


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    rows = [(f"l{k}", g, 5 + k) for k in range(6) for g in range(10)]
    m = langid.Model.fit(spark.createDataFrame(rows, "lang string, gram bigint, n bigint"))
    assert m.langs == ["l3", "l4", "l5"] and m.common == "l5"


def test_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = langid.op9_language_id(spark, d).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_identify_odd(spark, docs, texts, none):
    counts = langid.count_grams(docs)
    assert counts.filter("lang <> 'en'").count() == 0
    model = langid.train(docs)
    out = langid.identify(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "evidence", "n_grams"]
    got = {r.doc_id: r for r in out.collect()}
    for k, t in enumerate(texts):
        letters = bool(t) and any(c.isalpha() for c in t)
        assert got[k].lang_pred == ("en" if letters else "und") and got[k].text == t and (letters or got[k].score == 0)
    nothing = langid.train(none)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"} and langid.identify(none, model).count() == 0
