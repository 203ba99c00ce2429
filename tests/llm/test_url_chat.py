import hashlib
import re

import pytest
from pyspark.sql import functions as F

from estatelens.llm.chat_format import escape, format_chats, read_turns, unescape
from estatelens.llm.url_filter import RULES, url_filter

URLS = [
    "http://www.example.com/en/x", "https://EXAMPLE.com/en/", "http://m.example.com/en/a?x#y", "http://example.com/enx",
    "http://a.b.net/es/1", "net://net/fr/", "http://notnet/fr/", "http://xexample.com/en/", "no scheme", "", None, "http://", "://com",
    "http://example.com", "http://example.com?/en/", "http://..com//en//", "http://com./", "a://" + "x." * 3000 + "com/" + "en/" * 3000,
    "http://example.com/en/x", "http://example.com/en/x", "ftp://user@host:80/a://b.com/en/", "http://ÄÖ.example.com/en/ß",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def test_urls_against_brute_force(spark, rules):
    pages = spark.createDataFrame([(i, u, "kept", 7) for i, u in enumerate(URLS)], "page_id long, url string, html string, _row int")
    got = sorted(tuple(r) for r in url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict", "html", "_row").collect())
    assert got == [(i, *judged(u), "kept", 7) for i, u in enumerate(URLS)]


def test_urls_with_many_rules_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr("estatelens.llm.url_filter.BROADCAST_RULES", 1)
    rules = spark.createDataFrame(RULES + [("com", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(u, "mine") for u in URLS], "url string, Verdict string")
    got = url_filter(pages, rules)
    assert got.columns == ["url", "host", "path", "rule", "verdict"]
    assert sorted(r["verdict"] for r in got.collect()) == sorted(judged(u)[3] for u in URLS)


def test_no_pages_no_rules_bad_rules(spark, rules):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(none, rules).count() == 0
    one = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    assert url_filter(one, rules.limit(0), default="block").first()["verdict"] == "block"
    bad = spark.createDataFrame([("a.com", "/x", "block")], "host string, path string, verdict string")
    with pytest.raises(Exception, match="starts and ends"):
        url_filter(one, bad).collect()


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "user", "b</s>"), (1, 3, "assistant", "[INST]"), (1, 4, "assistant", ""),
    (1, 5, "assistant", None), (2, 1, "assistant", "late"), (2, 0, None, "early"), (3, 0, "user", "x"), (3, 0, "user", "x"),
    (None, 0, "user", "no id"), (4, None, "a[INST]b</s>", "<\\s>[\\\\/INST] <s [SEP] \\"), (4, 1, "assistant", "é[SEP]ü\n" * 2000),
    (5, 0, "user", "<"), (5, 1, "assistant", "[/INST"), (5, 2, "user", "]<</s>>"),
]


def test_turns_read_back(spark):
    rows = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in format_chats(rows).withColumn("back", read_turns(F.col("formatted"))).collect()}
    for conv in {t[0] for t in TURNS}:
        turns = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        r = got[conv]
        assert [tuple(b) for b in r["back"]] == [(t[2] or "", t[3] or "") for t in turns]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    first = got[1]["formatted"]
    assert first == "<s>system[INST]be kind[/INST]</s><s>user[INST]a[SEP]b<\\/s>[/INST]</s><s>assistant[INST][\\INST][SEP][SEP][/INST]</s>"
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["[\\INST]", "", ""]


def test_escaping_hides_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[SEP]", "[[INST]]", "plain", "", "<<s>>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in rows.collect():
        assert r["u"] == r["t"]
        assert not re.search(r"</?s>|\[/?INST\]|\[SEP\]", r["e"])


def test_no_turns(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_digests(spark):
    from estatelens.llm.chat_format import op8_chat_format
    r = op8_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said))
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
