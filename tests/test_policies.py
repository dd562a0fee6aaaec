"""Policies, HTML and prose, against facts stated by hand."""

from pyspark.sql import functions as F
from test_sessions import column

from ctxlake.functions import policy, prose
from ctxlake.functions import text as T


def test_addresses(spark):
    blocked = ["169.254.169.254", "127.0.0.1", "10.1.2.3", "192.168.0.1", "172.31.255.255", "100.64.0.1", "0.0.0.0", "224.0.0.1", "255.255.255.255", "::1", "::", "fe80::1%eth0", "fd00::1", "ff02::1", "::ffff:169.254.169.254", "::ffff:8.8.8.8", "::127.0.0.1", "64:ff9b::a00:1", "[::1]", "example.com", "1.2.3.256", "1.2.3", ""]
    allowed = ["8.8.8.8", "172.32.0.1", "1.1.1.1", "2606:4700:4700::1111", "192.0.1.1"]
    got = column(spark, blocked + allowed, policy.address_verdict)
    assert [g.blocked for g in got] == [True] * len(blocked) + [False] * len(allowed)
    assert got[0].reason == "link-local" and got[0].family == 4 and got[9].reason == "loopback" and got[14].reason == "link-local" and got[17].reason == "private" and got[19].family == 0 and got[-2].family == 6


def test_urls(spark):
    urls = {"http://a.com": "allowed", "HTTPS://u:p@A.com:443/x": "allowed", "http://a.com:80": "allowed", "http://a.com:6379/": "port-blocked", "ftp://a.com": "scheme-blocked", "file:///etc/passwd": "scheme-blocked", "nope": "bad-url", "http://": "bad-url", "http://[::1]:22/": "port-blocked"}
    assert column(spark, list(urls), policy.url_verdict) == list(urls.values())
    assert column(spark, ["http://u:p@A.com:81/x"], lambda u: policy.url_parts(u)["host"]) == ["a.com"]


def test_scripts(spark):
    bad = ["curl x", "import requests\nrequests.get('u')", "cat < /dev/tcp/1.2.3.4/80", "require('net').connect()", "import x from 'node:https'", "http.Get(u)", "Net::HTTP.get", "file_get_contents('http://x')", "fetch('https://x')", ":gen_tcp.connect", "download.file(u)", "new HttpClient()"]
    assert all(column(spark, bad, policy.network_use)) and column(spark, ["print(1)", "curly", "fetch_rows(x)", "open('a')"], policy.network_use) == [None] * 4
    assert column(spark, ["a\x1b[31mb\x1b[0m"], T.ansi_stripped) == ["ab"]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><!-- c --><script>var a='<p>';</script><style>p{}</style><h1>Head</h1><p>A &amp; B&nbsp;&#65;&#x42;&unknown; &#0;</p><a class='x' href='/u'>link</a><ul><li>one</li><li>two</li></ul>x<br/>y</body></html>"
    [got] = column(spark, [page], policy.html_text)
    assert got == "# Head\nA & B AB&unknown;\nlink (/u)\n- one\n- two\nx\ny"
    assert column(spark, ["&amp;lt; &#60; &hellip;"], policy.entities_decoded) == ["&lt; < …"]
    assert column(spark, [" <!DOCTYPE html>", "text"], lambda b: policy.looks_like_html(F.lit(None).cast("string"), b)) == [True, False]


def test_names(spark):
    tags = spark.createDataFrame([(t,) for t in ("v1.2.3", "1.10.0", "v1.9.9", "nightly", "v2.0")], "t string")
    assert tags.agg(F.max_by("t", policy.release_number(F.col("t"))).alias("m")).first().m == "1.10.0"
    assert column(spark, ["abc\trefs/tags/v1.0.0\ndef\trefs/tags/v1.0.0^{}\nx\trefs/heads/m\n"], policy.remote_tags) == [["v1.0.0"]]
    assert column(spark, ["httpx[http2]>=1", " rich ; x", "a"], policy.requirement_name) == ["httpx", "rich", "a"]
    assert column(spark, ["a/b.py", "../x", "/etc", "a\nb", "", "a/../b", "C:\\x", "a..b"], policy.safe_path) == [True, False, False, False, False, False, False, True]


def test_compression():
    assert prose.compress("I'll just check the file. Please really use `the code` at https://x.com/the/a and the_file. It seems fine ,  thanks.").startswith("check file. Use `the code` at https://x.com/the/a and the_file.")
    assert prose.compress("Call a run_all( ) or a.b.c() with the THE_NAME 1.2.3, the end") == "Call a run_all( ) or a.b.c() with the THE_NAME 1.2.3, end"
    assert prose.compress_fields({"description": "the cat", "a": [{"description": "a dog", "b": "the x"}]}) == {"description": "Cat", "a": [{"description": "Dog", "b": "the x"}]}
    assert prose.fenced_blocks("````\n```\nx\n```\n````\n~~~\ny\n~~~ \n```\nopen") == ["````\n```\nx\n```\n````", "~~~\ny\n~~~ "]
    before = "# T\n- a\n- b\n`x` `x` see ./a/b http://u.com\n```\nc\n```"
    assert prose.problems(before, before) == ([], []) and prose.problems(before, "- a\n`x` `y`") == (["heading count", "code blocks", "urls", "inline code lost"], ["headings", "paths", "bullets", "inline code added"])


def test_prose_columns(spark):
    [got] = column(spark, ["the cat sat"], prose.compressed)
    assert tuple(got) == ("Cat sat", 11, 7) and column(spark, ['{"description": "the cat"}', "x"], prose.compressed_json) == ['{"description": "Cat"}', "x"]
    df = spark.createDataFrame([("# a", "# a"), ("# a", "b")], "a string, b string")
    assert [tuple(r.v) for r in df.select(prose.validated("a", "b").alias("v")).collect()] == [([], []), (["heading count"], ["headings"])]
    files = {("a/Dockerfile", "x"): "code", ("Dockerfile.dev", "x"): "code", ("requirements-dev.txt", "x"): "config", ("a.txt", "x"): "natural_language", ("a.py", "x"): "code", ("a.yml", "x"): "config", ("a.bin", "x"): "unknown", ("TODO", "buy milk\nsee mum"): "natural_language", ("run", "#!/bin/sh"): "code", ("conf", '{"a": 1}'): "config", ("conf2", "a: 1\nb: 2\n- c: d"): "config", ("src", "import x\ndef f():\n  pass\n}"): "code", ("none", None): "unknown"}
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(files)], "i int, p string, t string")
    assert [r.x for r in rows.select("i", prose.file_type(F.col("p"), F.col("t")).alias("x")).orderBy("i").collect()] == list(files.values())
    assert column(spark, ["a/.ssh/x", ".env.local", "my-api_key.md", "id_rsa", "a.pem", "notes.md"], prose.sensitive_path) == [True] * 5 + [False]
    assert [tuple(x) for x in column(spark, ["---\na: 1\n---\nbody", "body"], prose.frontmatter)] == [("---\na: 1\n---\n", "body"), ("", "body")]
    assert column(spark, ["```md\nx\n```\n", "a ```x``` b"], prose.unwrapped) == ["x", "a ```x``` b"]
    assert [r.x for r in rows.select("i", prose.compressible(F.concat("p", F.lit(".original.md")), F.col("t")).alias("x")).collect()] == [False] * len(files)
