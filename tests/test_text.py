import pytest
from pyspark.sql import functions as F

from skeinlog.functions import configs, pricing, strings, times
from skeinlog.functions import markdown as M
from skeinlog.functions import text as X
from skeinlog.functions import tools


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("\x1b[32;1m Id\x1b[0m \x1b[32;1mResponding\x1b[0m\r\n50416 True \x1b]8;;file:///tmp/app\x07/tmp/app\x1b]8;;\x07\n", " Id Responding\n50416 True /tmp/app\n"),
        ("\x9b31merror\x9b0m", "error"),
        ("a\x1b]0;title\x1b\\b", "ab"),
        ("open \x1b]8;;never ends", "open "),
        ("cut \x1b[12", "cut "),
        ("end\x1b", "end"),
        ("keep [32m this", "keep [32m this"),
    ],
)
def test_terminal_controls(spark, raw, plain):
    assert one(spark, X.strip_terminal(F.lit(raw))) == plain


@pytest.mark.parametrize(
    "value, title",
    [(" Fix it ", "Fix it"), ("", None), ("  ", None), ("bad �", None), ("????", None), ("what? why? how? " + "x" * 30, "what? why? how? " + "x" * 30), ("a??", "a??")],
)
def test_readable_title(spark, value, title):
    assert one(spark, X.readable_title(F.lit(value))) == title


def test_fallback_title(spark):
    pick = lambda s, m: one(spark, X.fallback_title(F.lit("0123456789"), F.lit(s), F.lit(m)))
    assert pick("---\n<x>\n## Plan the work\n", "") == "Plan the work"
    assert pick("", "- first\nsecond") == "first"
    assert pick("\n", "é" * 200) == "é" * 200 and pick("\n", "") == "session 01234567"
    assert pick("x" * 120, "") == "x" * 120


@pytest.mark.parametrize(
    "text, query, want",
    [
        ("hello world", "world", "hello world"),
        ("a" * 60 + "NEEDLE" + "b" * 150, "needle", "..." + "a" * 40 + "NEEDLE" + "b" * 100 + "..."),
        ("no match here", "zzz", "no match here"),
    ],
)
def test_snippet(spark, text, query, want):
    assert one(spark, X.snippet(F.lit(text), query)) == want


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("Foo-bar a é 47.95 x1 " + "z" * 129))) == ["foo", "bar", "a", "é", "47", "95", "x1", "z" * 129]
    assert one(spark, X.tokens(F.lit("修复bug"))) == ["修", "复", "修复", "bug"]
    assert one(spark, X.tokens(F.lit("abc中文"))) == ["abc", "中", "文", "中文"]


def test_literal_query(spark):
    assert [one(spark, X.is_literal_query(F.lit(q))) for q in ("foo bar", "10.0.0.1", "foo-bar", "修复 bug")] == [False, True, True, False]


@pytest.mark.parametrize("text", ["plain ascii", "aé漢😀b", "😀😀😀", ""])
@pytest.mark.parametrize("n", range(0, 13))
def test_cut_bytes_matches_utf8_prefix(spark, text, n):
    want = text.encode()[:n].decode("utf-8", "ignore")
    assert one(spark, X.cut_bytes(F.lit(text), F.lit(n))) == want


def test_trim_uses_unicode_white_space(spark):
    assert one(spark, strings.trim(F.lit(" \n\t x y　 "))) == "x y"


def test_shell_output(spark):
    got = one(spark, X.shell_output(F.lit("Exit code: 0\nWall time: 1.5 seconds\nOutput:\nhello\nworld")))
    assert (got.body, got.exit_code, got.duration_ms, got.lifted) == ("hello\nworld", 0, 1500, True)
    plain = one(spark, X.shell_output(F.lit("Plan updated")))
    assert (plain.body, plain.exit_code, plain.lifted) == ("Plan updated", None, False)


def test_unwrap_read(spark):
    assert one(spark, X.unwrap_read(F.lit("<path>x</path><content>\na\n<content>b</content>\n</content>"))) == "a\n<content>b</content>"
    assert one(spark, X.unwrap_read(F.lit("no wrapper"))) == "no wrapper"


def test_highlight_escapes_first(spark):
    assert one(spark, X.highlight(F.lit("<b>Foo.</b> & foox"), "foo.")) == "&lt;b&gt;<mark>Foo.</mark>&lt;/b&gt; &amp; foox"
    assert one(spark, X.highlight(F.lit("aaa"), "a")) == "aaa"


def test_host_keys(spark):
    for host, user, tagged in [(None, None, "key/x"), ("Ubuntu", None, "@wsl:Ubuntu/key/x"), ("Ubuntu", "me", "@wsl:Ubuntu~me/key/x")]:
        lit = lambda v: F.lit(v).cast("string")
        assert one(spark, X.tag_key(lit(host), lit(user), F.lit("key/x"))) == tagged
        assert tuple(one(spark, X.split_key(F.lit(tagged)))) == (host, user, "key/x")


def test_model_ids(spark):
    assert [one(spark, pricing.normalized_id(F.lit(m))) for m in ("anthropic/Claude-Opus-4.6", "openai/gpt-5.4:batch", " ~x/y.z ")] == ["claude-opus-4-6", "gpt-5-4", "y-z"]
    assert [one(spark, pricing.per_million(F.lit(p))) for p in ("0.000003", "-1", "abc", "NaN", "Infinity")] == [3.0, None, None, None, None]


def test_times(spark):
    assert one(spark, times.local_text(F.lit("2026-01-02T03:04:05.678+02:00"))) == "2026-01-02 01:04:05"
    assert one(spark, times.local_text(F.lit("2026-01-02T03:04"))) == "2026-01-02 03:04"
    assert one(spark, times.epoch_text(F.lit(1767225600))) == one(spark, times.epoch_text(F.lit(1767225600000))) == "2026-01-01 00:00:00"


def test_front_matter(spark):
    doc = F.lit("---\nname: 'A b'\nmetadata:\n  k: 1\n  type: feedback\n---\n\nBody")
    block = M.front_matter(doc)
    assert one(spark, M.field(block, "name")) == "A b"
    assert one(spark, M.memory_type(F.lit("x.md"), block)) == "feedback"
    assert one(spark, M.memory_type(F.lit("MEMORY.md"), block)) == "index"
    assert one(spark, M.body(doc)) == "Body"
    assert one(spark, M.front_matter(F.lit("no front matter"))) is None


def test_config_text(spark):
    assert one(spark, configs.strip_toml_comment(F.lit("""a = "x # y" # z"""))) == """a = "x # y" """
    assert one(spark, configs.strip_toml_comment(F.lit("a = \"open # y"))) == "a = \"open # y"
    assert one(spark, configs.toml_array(F.lit("""["a, b", 'c', d , ""]"""))) == ["a, b", "c", "d"]
    assert one(spark, F.to_json(configs.parse_jsonc(F.lit('{"url":"https://x", // note\n "k": 1 /* b */}')))) == '{"k":1,"url":"https://x"}'


def test_tool_display(spark):
    assert one(spark, tools.tool_label(F.lit("mcp__a__b"))) == "a · b"
    assert one(spark, tools.tool_label(F.lit(None).cast("string"))) == "Tool"
    assert one(spark, tools.call_summary(F.lit('{"file_path":"/a/b/c.py"}'))) == "b/c.py"
    assert one(spark, tools.custom_answers(F.array(F.lit("A, B"), F.lit("other"), F.lit("A")), F.array(F.lit("A"), F.lit("B")))) == ["other"]
