"""Text, timestamp and HTML functions against Python's own semantics."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetext.functions import html, timestamps
from kinetext.functions import text as tx

ALPHABET = st.text(alphabet="ab `<>!$^#/.?\n\t\r\x1c\x85\xa0 　éİß_1-", max_size=30)
DROP = [(r"```[\s\S]*?```", 0), (r"`[^`]+`", 0), (r"^    .*$", re.M), (r"<![^>]*>", 0), (r"<[^>]+>", 0), (r"^#!/.*$", re.M), (r">\s*[^<\n]+", 0), (r"\$\s*[!][!$^]", 0)]


def clean(t):
    for p, f in DROP:
        t = re.sub(p, "", t, flags=f)
    return t


@settings(max_examples=10, deadline=None)
@given(st.lists(ALPHABET, min_size=50, max_size=200))
def test_fuzzed_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    c = F.col("t")
    for r in df.select("i", tx.clean_text(c).alias("c"), tx.normalize_whitespace(c).alias("n"), tx.word_set(c).alias("w"), tx.exclamation_counts(c).alias("e"), tx.text_key(c).alias("k")).collect():
        t = texts[r.i]
        assert r.c == clean(t) and r.n == " ".join(t.split())
        assert set(r.w) == set(re.sub(r"[^\w\s]", "", t.lower()).split()) and len(set(r.w)) == len(r.w)
        x = clean(t)
        total, opening, closing = x.count("!"), int(bool(re.search(r"^[^.!?]*!", x.strip(), re.M))), int(x.rstrip().endswith("!"))
        assert tuple(r.e) == (total, opening, closing, total - opening - (closing if opening != closing else 0))
        assert r.k == hashlib.sha256(t.encode()).hexdigest()[:16]


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_goldens(spark):
    assert one(spark, tx.jaccard_similarity, "the cat sat", "the dog sat") == 0.5
    assert one(spark, tx.jaccard_similarity, "", "") == 0.0
    assert one(spark, tx.text_key, "hello") == "2cf24dba5fb0a30e"
    for text, want in (("Wow! a! b!", (3, 1, 1, 2)), ("Hi. ok\nWow! x", (1, 1, 0, 0)), ("No. Yes!", (1, 0, 1, 0)), (None, (0, 0, 0, 0))):
        assert tuple(one(spark, tx.exclamation_counts, text)) == want
    assert one(spark, lambda c: tx.preview(c, 3), "abcd") == "abc..." and one(spark, lambda c: tx.preview(c, 4), "abcd") == "abcd"


def test_timestamps(spark):
    assert one(spark, timestamps.takeout_timestamp, "Sep 15, 2024, 6:08:45 PM MDT") == "2024-09-15T18:08:45Z"
    assert one(spark, timestamps.takeout_timestamp, "garbage") == "1970-01-01T00:00:00Z"
    assert one(spark, timestamps.month, "2024-03-31T23:30:00-05:00") == "2024-03"
    assert one(spark, timestamps.parse_timestamp, "2023-10-30") is None
    iso = lambda c: timestamps.to_iso8601(timestamps.parse_timestamp(c))
    assert one(spark, iso, "2023-10-30 02:19:40") == "2023-10-30T02:19:40Z" and one(spark, iso, "2023-10-30T02:19:40+02:00") == "2023-10-30T00:19:40Z"
    assert one(spark, iso, None) is None and one(spark, iso, "x T y") is None


def test_html():
    assert html.extract("<p>A</p><ul><li>x</li><li>y</li></ul>") == "A\n\n• x\n\n• y"
    assert html.extract("<p>a <b>b</b> c</p>") == "abc"
    assert html.extract("plain") == "plain" and html.extract("") == "" and html.extract(None) == ""
    assert html.extract("<!DOCTYPE html><html><body><p>a</p><p>b</p><script>x</script></body></html>") == "a\nb"
    assert html.extract("<div>a<!-- c -->b</div>", False) == "a b"
    assert html.extract("<p>a &amp; b</p>") == "a & b"


def test_messages(spark):
    df = spark.createDataFrame([("1", "<p>hi</p>", None), ("2", None, "yo"), ("3", "", None)], "id string, h string, p string")
    at = F.lit("2024-01-01T00:00:00Z")
    rows = df.select(html.message(F.col("id"), at, F.lit("User"), F.col("h"), F.col("p"), F.lit("f"), F.lit("file"), F.lit("webui"), at).alias("m")).select("m.*").orderBy("message_id").collect()
    assert [r.text for r in rows] == ["hi", "yo", ""] and rows[0].extraction.version == "1.0" and rows[0].text_html == "<p>hi</p>"
    assert rows[1].extraction is None and not rows[1].has_thinking and rows[0].timestamp_source == "webui"


def test_sentences(spark):
    from kinetext.operators import sentences

    rows = {
        "It costs 3.14 dollars. Dr. X agrees, e.g. today. J. R. Smith left!": ["It costs 3.14 dollars.", "Dr. X agrees, e.g. today.", "J. R. Smith left!"],
        'He said "Go!" Then he went...  And\nnow? "Yes." End': ['He said "Go!"', "Then he went...", "And now?", '"Yes."', "End"],
        "See example.com/a.b now. ... !!! Ok.": ["See example.com/a.b now.", "Ok."],
        "": [], "...": [], "no end": ["no end"],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", sentences.regex_sentences(F.col("t")).alias("s"))
    assert [r.s for r in df.orderBy("k").collect()] == list(rows.values())
    asked = sentences.parser_sentences("halves", load=lambda: lambda t: t.split(","))
    d = spark.createDataFrame([(1, "a, b,"), (2, None)], "doc_id int, text string")
    assert [(r.doc_id, r.pos, r.sentence) for r in sentences.split(d, asked).collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_basic_iso(spark):
    rows = ["20240331T233000Z", "20240331T233000+0200", "20240331T233000", "2024-03-31T23:30:00-0500", "20240331", "20241331T000000Z", "2024-03-31T23:30:00.5Z"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = df.select("k", timestamps.to_iso8601(timestamps.parse_timestamp(F.col("t"))).alias("p"), timestamps.month(F.col("t")).alias("m")).orderBy("k").collect()
    assert [r.p for r in got] == ["2024-03-31T23:30:00Z", "2024-03-31T21:30:00Z", "2024-03-31T23:30:00Z", "2024-04-01T04:30:00Z", None, None, "2024-03-31T23:30:00Z"]
    assert [r.m for r in got] == ["2024-03", "2024-03", "2024-03", "2024-03", None, None, "2024-03"]
