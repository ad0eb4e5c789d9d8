import pytest

from kestrelflow.llm import chat, queries, urls
from tests.oracle import connect, same


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_line_dedup", "op4_url_filter"])
def test_as_sql(spark, sf_dir, name):
    assert same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) > 0


def test_round_trip_of_hard_texts(spark):
    texts = ["<|im_end|>", "<\\|im_end|>\n", "\\", "\\\\<|", "", None, "<|im_sep|>", "a<\\!b", "\n\n", "<<||>", "\\<\\|", "x" * 200_000]
    rows = [(1, i, "assistant" if i % 3 else "us\n<|er\\<\\!", t) for i, t in enumerate(texts)]
    rows += [(2, 0, None, "q"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, None, "user", "z")]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, segments string, heads int")
    out = {r.conv_id: r for r in chat.format_conversations(frame).withColumn("turns", chat.parsed(chat.F.col("formatted"))).withColumn("loss", chat.trained_text(chat.F.col("segments"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert [(t.role, t.text) for t in out[2].turns] == [("", "q"), ("assistant", "a"), ("assistant", "b"), ("assistant", "a"), ("assistant", "a")]
    assert out[2].formatted == "<|im_start|>\nq<|im_end|>\n<|im_start|>assistant\na<|im_sep|>b<|im_sep|>a<|im_sep|>a<|im_end|>\n"
    assert out[1].loss == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert out[None].formatted == "<|im_start|>user\nz<|im_end|>\n"
    assert chat.format_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 10_000])
def test_rules_and_index(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_BROADCAST", most)
    rules = [urls.site_rule("net/", "block"), urls.site_rule("example.net/en/", "allow"), urls.site_rule("a.b/x", "block"), urls.word_rule("login")]
    cases = {
        "http://Sub.EXAMPLE.net/en/1": "example.net/en/", "http://example.net/EN/1": "net/", "http://example.net": None, "http://example.net/": "net/",
        "http://badexample.net/en/": "net/", "x://net/": "net/", "http://a.b/xyz?q": "a.b/x", "http://c.a.b/x": "a.b/x", "http://a.b.c/x": None,
        "nothing": None, "": None, "http://q.com/login": None, "http://q.com/login/": None, "http://q.com/loginx": None, "a://b://net/": None,
    }
    rows = [(i, u, "h", "p") for i, u in enumerate(cases)] + [(None, None, "h", "p"), (0, "x://net/", "h", "p"), (0, "x://net/", "h", "p")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    out = urls.judge_urls(frame, rules).collect()
    assert sorted((r.url, r.rule) for r in out if r.url is not None) == sorted([*cases.items(), ("x://net/", "net/"), ("x://net/", "net/")], key=str)
    verdicts = {r.url: r.verdict for r in out}
    assert (verdicts["http://q.com/login"], verdicts["http://q.com/login/"], verdicts["http://q.com/loginx"], verdicts[None]) == ("block", "block", "allow", "allow")
    fetched = {r.url: r.fetched for r in out}
    assert fetched["nothing"] == 0 and fetched["http://Sub.EXAMPLE.net/en/1"] == 2
    assert urls.judge_urls(frame.limit(0), rules).count() == 0
    assert urls.judge_urls(frame, []).where("verdict = 'allow'").count() == len(rows)


def test_many_rules_are_found_by_their_tokens(spark):
    rules = [urls.site_rule(f"site{i}.org/p{i}/", "block") for i in range(2000)]
    rows = [(i, f"http://www.site{i}.org/p{i if i % 2 else 0}/x") for i in range(0, 4000, 7)]
    out = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.page_id: (r.rule, r.fetched) for r in out.collect()}
    fits = lambda i: i < 2000 and (i % 2 == 1 or i == 0)
    assert got == {i: (f"site{i}.org/p{i}/" if fits(i) else None, int(fits(i))) for i, _ in rows}
