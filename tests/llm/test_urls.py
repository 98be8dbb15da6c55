import random
import re

from pyspark.sql import functions as F

from tokenscope.llm import urls
from tokenscope.llm.common import prepare


def brute(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = re.split(r"[?#]", rest[k:])[0]
    fits = [(r, v) for r, v in urls.HOST_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        return host, path, *max(fits, key=lambda x: len(x[0]))
    hit = url is not None and any(re.search(p, url, re.I | re.A) for p, v in urls.PATTERN_RULES)
    return host, path, None, "block" if hit else "allow"


def make(seed, n=600):
    r = random.Random(seed)
    bits = "http https :// / // ? # . www example net com org de en fr spam-farm cheap-pills cheap pills casino xxx Example NET wp-login.php utm_medium=spam & é \n free-money :8080 user@ _".split(" ")
    out = ["".join(r.choice(bits) for _ in range(r.randrange(10))) for _ in range(n)]
    out += [f"https://{r.choice(['a.', 'WWW.', ''])}{r.choice(['example', 'spam-farm.example', 'x'])}.{r.choice(['net', 'com', 'org', 'nett'])}{r.choice(['/en/', '/de/1', '/fr/x?y', '', '/', '?a', '/EN/'])}" for _ in range(n)]
    return [*out, None, "", "://", "net/", "http://net/", "http://net", "http://x.net\n/", "http://a/b.net\n/"]


def test_equals_brute_force(spark):
    prepare(spark)
    rows = list(enumerate(make(1)))
    rows += [(3, rows[3][1]), (None, "http://spam-farm.org/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "token": F.lit("x")})
    got = sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.judge(df, ["page_id"]).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in rows), key=str)
    assert len({x[3:] for x in got}) == 6
    assert urls.judge(df.limit(0), ["page_id"]).count() == 0


def test_required_tokens():
    assert urls.required_tokens(r"\bcheap-pills\b") == [{"cheap", "pills"}]
    assert urls.required_tokens(r"cheap-pills") == [set()]
    assert urls.required_tokens(r"/wp-login\.php\b") == [{"wp", "login", "php"}]
    assert urls.required_tokens(r"\ba(?:b|c)\b") == [set()]
    assert urls.required_tokens(r"-(?:big)-x*") == [{"big"}]
    assert urls.required_tokens(r"\b(?:casino|viagra)\b") == [{"casino"}, {"viagra"}]
    assert urls.required_tokens(r"\bfree-(?:money|prizes)\b") == [{"free", "money"}, {"free", "prizes"}]
    assert urls.required_tokens(r"\b(?:one|[a-z]+)\b") == [{"one"}, set()]
    assert urls.required_tokens("(?:a|b-)" * 30 + r"\bx\b")


def test_every_rule_here_has_its_tokens():
    rules = tuple(urls.host_rule(*x) for x in urls.HOST_RULES) + tuple(urls.Rule(p, p, v, False) for p, v in urls.PATTERN_RULES)
    index = urls.Index(rules, {})
    assert not index.always and index.judge("http://nothing.here/")[4] == 0
    assert index.judge("casino")[3] == "block" and index.judge("casino")[4] == 1


def test_rules_rest_under_their_rarest_token():
    rules = tuple(urls.Rule(p, p, "block", False) for p in (r"\bcheap-pills\b", r"[a-z]+\d"))
    index = urls.Index(rules, {"cheap": 10, "pills": 2})
    assert list(index.under) == ["pills"] and len(index.always) == 1
    assert index.judge("http://a/cheap")[4] == 1 and index.judge("http://a/pills")[4] == 2


def test_any_number_of_alternatives_keeps_its_tokens():
    words = [f"w{i}" for i in range(3000)]
    assert urls.required_tokens(rf"\b(?:{'|'.join(words)})\b") == [{w} for w in words]
    some, more = "|".join(words[:100]), "|".join(words[100:200])
    assert all(urls.required_tokens(rf"\b(?:{some})-(?:{more})\b"))
    assert all(urls.required_tokens(rf"(?:{some.replace('w', '[a-z]')})-(?:{more})\b"))
    rule = urls.Rule("r", rf"\b(?:{'|'.join(words)})\b", "block", False)
    index = urls.Index((rule,), {})
    assert not index.always and index.judge("http://a/w2999")[3] == "block" and index.judge("http://a/none")[4] == 0
