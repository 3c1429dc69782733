import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kbspark.functions import records as R, tags as G, text as T
from kbspark.operators import distill, pages, privacy, search, threads, validate
from kbspark.plans import library, registry  # noqa: F401 - library adds its queries
from kbspark.sources import readers, sinks


def one(spark, col, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()[0]


def test_hmac_is_the_standard_one(spark):
    for salt in (b"s", b"x" * 80):
        assert one(spark, R.hmac_sha256(salt, F.col("a")), a="Ann Ö") == hmac.new(salt, "Ann Ö".encode(), hashlib.sha256).hexdigest()


def test_middle_out_closed_form(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        blocks = ["x" * rng.randint(0, 9) for _ in range(rng.randint(1, 9))]
        rows += [(k, i, b) for i, b in enumerate(blocks)]
        left = list(enumerate(blocks))
        while len(left) > 1 and sum(len(b) for _, b in left) > 20:
            left.pop(len(left) // 2)
        want[k] = [(i, b[:20] if len(left) == 1 else b) for i, b in left]
    got = threads.within_budget(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t", 20).collect()
    for k in want:
        assert sorted((r["i"], r["t"]) for r in got if r["k"] == k) == want[k]


def test_keep_comments(spark):
    rows = [(1, i, i) for i in range(50)] + [(2, i, i) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, at int, tie int").withColumn("closed", F.when(F.col("k") == 2, 3))
    got = threads.keep_comments(df, "k", "at", "closed", "tie").collect()
    assert sorted(r["at"] for r in got if r["k"] == 1) == [*range(15), *range(25, 50)]
    assert sorted(r["at"] for r in got if r["k"] == 2) == list(range(10))


def test_tags(spark):
    assert one(spark, F.array_join(G.scan(F.col("a")), ","), a="My Dexcom G7 and omnipod dash") == "G7,DASH,Dexcom"
    assert one(spark, G.canonical(F.col("a")), a="Dexcom G7") == "G7"
    assert one(spark, G.canonical(F.col("a")), a="Pixel 8") is None
    assert one(spark, F.array_join(G.versions(F.col("a")), ","), a="Android 13, android 7 and ANDROID 13 xandroid 9") == "Android 13"


def test_quotes_and_entries(spark):
    assert one(spark, T.quoted_in(F.col("a"), F.col("b")), a="See  [the DOCS](x)", b="please see [the docs](https://y/z) now")
    assert not one(spark, T.quoted_in(F.col("a"), F.col("b")), a=" ", b="text")
    assert one(spark, T.named_in(F.col("a"), F.col("b")), a="Galaxy S22", b="my galaxys 22 s22")
    assert not one(spark, T.named_in(F.col("a"), F.col("b")), a="!", b="text")


RECORD = {"issue_id": 3, "repo": "a/b", "url": "https://github.com/a/b/issues/3", "title": "t", "symptom": None, "cause": None, "fix": "do it", "settings_changed": ["Alarm → off"], "devices": ["G7"], "android_versions": [], "driver_tags": [], "confidence": "low", "evidence_quote": "the alarm is off"}


@pytest.mark.parametrize(
    "change, part",
    [({}, ""), ({"fix": 1}, "fix must"), ({"issue_id": True}, "issue_id"), ({"confidence": "sure"}, "confidence"), ({"evidence_quote": "never said so"}, "word for word"), ({"devices": ["G6"]}, "devices entry"), ({"settings_changed": ["Volume->1"]}, "settings_changed entry"), ({"url": None}, "url must")],
)
def test_record_rules(spark, change, part):
    errors = one(spark, F.array_join(validate.record_errors(F.col("a"), F.col("b")), "; "), a=json.dumps(RECORD | change), b="With G7 the alarm is off.")
    assert part in errors if part else errors == ""


def test_missing_is_not_null(spark):
    j = dict(RECORD)
    del j["cause"]
    assert one(spark, F.array_join(validate.record_errors(F.col("a"), F.col("b")), ";"), a=json.dumps(j), b="") == "missing required field 'cause'"
    assert one(spark, F.array_join(validate.record_errors(F.col("a"), F.col("b")), ";"), a="[1]", b="") == "record is not a JSON object"


def test_anonymise_is_fail_closed(spark, tmp_path):
    post = {"id": "p/1", "groupName": "My Group", "permalink": "https://facebook.com/groups/77/p1", "timestamp": 1700000000, "text": "hello", "postReactionsCount": 12, "comments": [{"commentAuthor": {"id": "9", "name": "Jane Roe"}, "commentText": "hi", "date": "2024-01-02T03:04:05+01:00"}]}
    df = privacy.anonymise(spark.createDataFrame([(json.dumps(post),)], "value string"), b"salt")
    r = df.first()
    assert r["stem"] == "my-group-p1" and r["posted_at"] == "2023-11-14T22:13:20Z" and r["reactions_count"] == 12 and r["errors"] == []
    assert r["comments"][0]["pseudonym"].startswith("member-") and r["comments"][0]["posted_at"] == "2024-01-02T02:04:05Z"
    bad = json.dumps(post | {"text": "says jane  ROE."})
    df = privacy.anonymise(spark.createDataFrame([(bad,)], "value string"), b"salt")
    with pytest.raises(validate.GateError):
        sinks.write_all_or_nothing(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_names(spark):
    assert not one(spark, privacy.name_in(F.col("a"), F.col("b")), a="Ann Lee", b="joann lees")
    assert one(spark, privacy.name_in(F.col("a"), F.col("b")), a="Ann Lee", b="by ANN  Lee!")
    j = json.dumps({"user": {"name": "A B", "x": ["no"]}, "handle": ["c"], "deep": [{"author": "D"}]})
    got = privacy.strings(spark.createDataFrame([(1, j)], "id int, j string"), "id", "j", names=True)
    assert sorted(r["value"] for r in got.collect()) == ["A B", "D", "c"]


def test_name_leaks_behind_punctuation(spark):
    names = ["Alo B", "x Yan", "Ann Lee Roe", "d'Arc Jo", "Étou Ka", "Élodie", "Ärzte Ö", "Иван Ли", "Ann Lee", "Zoé", "日本人"]
    texts = ['said "étou ka"', "l'amie d'Élodie.", "(ärzte ö)", "«иван ли»", "xИван Ли", '"Ann  LEE"', "by zoé!", "annlee joann lee", "新日本人民", "", None, "éÉlodie", "(alo b) and x  yan", "ann lee\nroe", "«d'arc jo»", "xalo b alob"]
    df, roster = spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["id"], r["name"]) for r in privacy.name_leaks(df, roster, id_col="id").collect()}
    want = df.crossJoin(roster).where(privacy.name_in(F.col("name"), F.col("text"))).collect()
    assert got == {(r["id"], r["name"]) for r in want}
    assert {(0, "Étou Ka"), (1, "Élodie"), (2, "Ärzte Ö"), (3, "Иван Ли"), (5, "Ann Lee"), (8, "日本人")} <= got


def test_quotes_of_any_length(spark):
    quotes = ["ox", "jump", "wn fo", "k b", "ck brown f", "ick brown fox ju", "ck brown fox jumps ov", "see [docs](x) now", "the [docs](a) are [here](b) for all", "q", " ", None, "fox jumps over the lazy dog"]
    texts = ["The quick  brown fox jumps over the lazy dog", "please see [docs](https://y/z) now", "the [docs](https://y/z) are [here](w) for all", "the [docs] are [here] for all to see [docs] now", "", None, "fox", "The quick  brown fox jumps over the lazy dog"]
    df, q = spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame(list(enumerate(quotes)), "n int, quote string")
    of = T.quoted_in(F.col("quote"), F.col("text"))
    got = sorted((r["id"], r["n"]) for r in registry.quoted_pairs(df, q, of).collect())
    assert got == sorted((r["id"], r["n"]) for r in df.crossJoin(q).where(of).collect())
    assert {(0, n) for n in range(7)} | {(1, 7), (3, 7), (2, 8), (3, 8)} <= set(got)
    assert all(r == (6, 0) for r in got if r[0] == 6)


def test_markdown():
    html = '<nav>x</nav><h1>T<a class="headerlink" href="#">#</a></h1><p>a &amp; <b>b</b></p><ul><li>one</li><li>two</li></ul><hr><script>var t="</p>";</script>'
    assert pages.to_markdown(html) == "# T\na &  b\n- one\n- two\n---"


def test_references_without_a_semicolon(spark, tmp_path):
    html = "<h1>a &amp</h1><p>&lt;b&gt &amp;lt; &#65; &nosuch; &ampx; x&&amp;y &am</p>"
    assert pages.to_markdown(html) == "# a &\n<b> &lt; A &nosuch; &x; x&&y &am"
    assert pages.to_markdown(html, bare=False) == "# a &amp\n<b&gt &lt; A &nosuch; &ampx; x&&y &am"
    rows = [(1, "<body><h1>Cut at &amp</h1><p>and&amp;&amp;&am</p></body>"), (2, "<body><h1>&lt;t&quot;</h1><p>x &amp y</p><footer>&copy;</footer></body>")]
    spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["markdown"] for r in registry.QUERIES["html_to_markdown"](spark, str(tmp_path)).collect()}
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert dict(con.sql(registry.SQL["html_to_markdown"]).fetchall()) == got == {1: "# Cut at &amp\nand&&&am", 2: '# <t"\nx &amp y'}


def test_markdown_to_html(spark):
    df = spark.createDataFrame([(1, "# T\n- a\n- **b**\n\ntext <x>")], "k int, md string")
    assert pages.to_html(df, "k", "md").first()["html"] == "<h1>T</h1>\n<ul><li>a</li>\n<li><strong>b</strong></li></ul>\n<p>text &lt;x&gt;</p>"


def test_markdown_query_takes_all_documents(spark, tmp_path):
    rng = random.Random(7)
    kinds = ["# a & b", "### c", "- one", "* **two**", "3. three", "---", "****", "plain `x<y`", "", "  - in", "-none", "#none", "*em* end"]
    docs = ["\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["- item", "# title", "text"]

    def inline(s):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            s = s.replace(a, b)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        return re.sub(r"\*([^*]+)\*", r"<em>\1</em>", re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", s))

    def loop(text):
        out, inside = [], False
        for line in filter(None, (x.strip(" ") for x in text.split("\n"))):
            item, head = re.match(r"(?:[-*]|\d+\.) +(.*)", line), re.match(r"(#{1,6}) +(.*)", line)
            if inside and not item:
                out[-1] += "</ul>"
            if item:
                out.append(("" if inside else "<ul>") + f"<li>{inline(item[1])}</li>")
            elif head:
                out.append(f"<h{len(head[1])}>{inline(head[2])}</h{len(head[1])}>")
            else:
                out.append("<hr>" if re.fullmatch(r"-{3,}|\*{3,}", line) else f"<p>{inline(line)}</p>")
            inside = bool(item)
        return "\n".join(out) + ("</ul>" if inside else "")

    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["html"] for r in registry.QUERIES["markdown_to_html"](spark, str(tmp_path)).collect()}
    assert got == {i: loop(x) for i, x in enumerate(docs) if x.strip()}
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.sql(registry.SQL["markdown_to_html"]).fetchall()) == got


def test_docs_and_corrupt_files(spark, tmp_path):
    (tmp_path / "my-doc.md").write_text("# Source: <https://x.y/z>\n\n# Hello\nbody\n")
    r = readers.read_docs(spark, str(tmp_path)).first()
    assert (r["slug"], r["source_url"], r["title"]) == ("my-doc", "https://x.y/z", "Hello")
    (tmp_path / "a-1.json").write_text('{"id": 1, "repo": "o/a", "number": 1, "comments": []}')
    (tmp_path / "a-2.json").write_text('{"id": ')
    assert [r["stem"] for r in readers.read_threads(spark, str(tmp_path)).collect()] == ["a-1"]


def test_distill_retries_once(spark, tmp_path):
    def model(text, hint):
        if text == "broken":
            raise OSError("down")
        quote = text if hint or text == "good words" else "nowhere said"
        return json.dumps({k: v for k, v in (RECORD | {"evidence_quote": quote, "devices": [], "settings_changed": []}).items() if k not in ("issue_id", "repo", "url")}), 10, 5

    def store(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = spark.createDataFrame([("a", "good words"), ("b", "second try"), ("c", "broken")], "stem string, text string")
    got = {r["stem"]: r for r in distill.distill(rows, model, store, keys=validate.SOCIAL_KEYS).collect()}
    assert (got["a"]["attempts"], got["a"]["errors"]) == (1, []) and (got["b"]["attempts"], got["b"]["errors"]) == (2, [])
    assert "down" in got["c"]["errors"][0]


def test_empty_query(spark):
    docs = spark.createDataFrame([("r", 0, "doc", "t", "word")], "rec_id string, build_ord bigint, kind string, title string, text string")
    assert search.search(docs, {1: "the of"}).count() == 0
    assert search.search(docs, {1: "word constructor"}).first()["matched"] == 1


def test_tokens_fold_every_script(spark):
    assert one(spark, F.array_join(T.tokens(F.col("a")), ","), a="Ｆｕｌｌ Ｗｉｄｔｈ cafe\u0301 ﬁne ﬂow Tiếng ½5 ĳs ⁴²") == "full,width,cafe,fine,flow,tieng,25,ijs,42"
    text = "Ｆｕｌｌ cafe\u0301 ﬁne ŉo Ǆab ½ Ünï 日本 Ångström"
    assert one(spark, F.array_join(T.tokens(F.col("a")), ","), a=text) == one(spark, F.array_join(T.tokens(F.col("a"), exact=True), ","), a=text)


def test_salt_is_kept(tmp_path):
    path = tmp_path / "a" / "salt"
    made = R.load_salt("S", str(path), {})
    assert len(made) == 64 and R.load_salt("S", str(path), {}) == made and R.load_salt("S", str(path), {"S": " own "}) == b"own"
    assert path.stat().st_mode & 0o777 == 0o600
    path.write_text(" \n")
    assert len(R.load_salt("S", str(path), {})) == 64
    with pytest.raises(OSError):
        R.load_salt("S", "/proc/no/salt", {})


def test_endpoint_and_client(tmp_path):
    (tmp_path / "key.json").write_text('{"x": {"key": "from file"}}')
    where = ("P", str(tmp_path / "key.json"), "x", "https://h/", "m")
    assert distill.endpoint(*where, {}) == {"base": "https://h", "model": "m", "key": "from file"}
    assert distill.endpoint(*where, {"P_API_KEY": "k", "P_MODEL": "n", "P_BASE_URL": "https://g//"}) == {"base": "https://g", "model": "n", "key": "k"}
    for bad in ("{", "{}"):
        (tmp_path / "key.json").write_text(bad)
        with pytest.raises(ValueError):
            distill.endpoint(*where, {})
    asked = []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return b'{"choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}'

    ask = distill.chat_client({"base": "https://h", "model": "m", "key": "k"}, "system", lambda r, timeout: asked.append(r) or Answer())
    assert ask("text", "") == ("{}", 3, 2) and ask("text", "bad quote") == ("{}", 3, 2)
    assert asked[0].full_url == "https://h/chat/completions" and asked[0].headers["Authorization"] == "Bearer k"
    assert "bad quote" in json.loads(asked[1].data)["messages"][1]["content"]
    with pytest.raises(ValueError):
        distill.chat_client({"base": "http://h", "model": "m", "key": "k"}, "")


def test_listings_stop():
    pages = {f"u{p}": json.dumps([{"n": p * 10 + i, **({"pull_request": {}} if i == 2 else {})} for i in range(3 if p < 4 else 1)]) for p in range(1, 6)}
    got = lambda **o: [x["n"] for _, x in readers.listed("u{page}", fetch=lambda u: pages.get(u, "[]"), **o)]
    assert got(pages=12, skip="pull_request") == [10, 11, 20, 21, 30, 31, 40, 50]  # until a page is empty
    assert got(pages=12, size=3) == [10, 11, 12, 20, 21, 22, 30, 31, 32, 40]  # until a page is short
    assert got(pages=12, pool=3, skip="pull_request") == [10, 11, 20, 21]  # until there are enough
    assert got(pages=2) == [10, 11, 12, 20, 21, 22]
    read = readers._Pages({"urls": "u{page}", "pool": "3", "skip": "pull_request"}, fetch=lambda u: pages[u])
    assert [json.loads(r[2])["n"] for p in read.partitions() for r in read.read(p)] == [10, 11, 20, 21]


def test_get_waits_and_gives_up():
    import urllib.error

    waits, tries = [], []

    class Page:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return b"ok"

    def opener(request, timeout):
        tries.append(request)
        codes = {1: (429, {"Retry-After": "7"}), 2: (403, {"Retry-After": "5000"}), 3: (502, {})}
        if len(tries) in codes:
            code, headers = codes[len(tries)]
            raise urllib.error.HTTPError("u", code, "x", headers, None)
        return Page()

    assert readers.get("https://h/", pause=0.5, opener=opener, sleep=waits.append) == "ok"
    assert waits == [0.5, 7, 900, 4]
    with pytest.raises(ValueError):
        readers.get("file:///etc/passwd")
    done = type("Done", (), {"returncode": 0, "stdout": '[{"a": 1}]', "stderr": ""})
    assert readers.get_by(["client", "x"], lambda *a, **k: done) == [{"a": 1}]
    done.returncode, done.stderr = 1, "no login"
    with pytest.raises(OSError, match="no login"):
        readers.get_by(["client"], lambda *a, **k: done)


def test_upsert_survives_a_failed_rename(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int")
    sinks.upsert(rows((1, 1), (2, 1)), path, ["k"], "at")
    with pytest.raises(OSError):
        sinks.swap(spark, str(tmp_path / "not there"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 1)]
    sinks.upsert(rows((2, 5), (3, 1)), path, ["k"], "at")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 5), (3, 1)]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_state_and_rosters_fail_loudly(spark, tmp_path):
    assert readers.read_state(spark, str(tmp_path / "none"), "k int").count() == 0
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises
        readers.read_state(spark, str(tmp_path / "state"), "k int").collect()
    (tmp_path / "roster.json").write_text('["a", 3]')
    with pytest.raises(Exception, match="array of strings"):
        readers.read_roster(spark, str(tmp_path / "roster.json")).collect()


def test_index_reads_only_its_words(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = [(f"r{i}", i, "doc", rng.choice(words), " ".join(rng.choice(words) for _ in range(20))) for i in range(100)]
    docs = spark.createDataFrame(rows, "rec_id string, build_ord bigint, kind string, title string, text string")
    index = search.write_index(docs, str(tmp_path / "index"))
    asked = {1: "word7 word9", 2: "word200", 3: "the of", 4: "word3 nothere"}
    rank = lambda x: sorted(tuple(r) for r in search.search(x, asked, 5).collect())
    assert rank(index) == rank(docs) and len(rank(index)) > 5
    plan = index.of(["word7"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan or "EqualTo(term" in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        search.read_index(spark, str(tmp_path / "nowhere"))


def test_forced_sync_fetches_all(spark, tmp_path):
    from kbspark.streaming import sync

    path = str(tmp_path / "table")
    sinks.upsert(spark.createDataFrame([(1, 1, "old")], "k int, at int, v string"), path, ["k"], "at")
    listing = spark.createDataFrame([(1, 1), (2, 1)], "k int, at int")
    fetch = lambda todo: todo.withColumn("v", F.lit("new"))
    saved = readers.read_state(spark, path, "k int, at int, v string")
    assert [r["k"] for r in sync.changed(listing, saved, "k", "at", 1).collect()] == [2]
    sync.sync(listing, saved, fetch, path, "k", "at", force=True)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_frequencies_travel_without_ids(spark, tmp_path):
    rows = [("a", "Été one", "one two été"), ("b", None, "two ⅝ ﬁne"), ("c", "the", ""), ("b", "two three", "one")]
    docs = lambda rows: spark.createDataFrame(rows, "rec_id string, title string, text string")
    got = lambda rows: {r["term"]: r["df"] for r in search.frequencies(docs(rows)).collect()}
    assert got(rows) == {"ete": 1, "one": 2, "two": 2, "fine": 1, "three": 1}  # an id in two rows counts once
    assert got(rows[:3]) == {"ete": 1, "one": 1, "two": 2, "fine": 1}
    plan = search.frequencies(docs(rows[:3]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(term" in plan and "hashpartitioning(rec_id" not in plan


@pytest.mark.parametrize("name", "document_frequency search_tfidf_topk search_multi_query search_post_filter search_snippet acceptance_queries".split())
def test_queries_write_no_index(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("a query stores an index of all words")

    monkeypatch.setattr(search, "write_index", never)
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    if name in ("search_post_filter", "search_snippet"):
        assert "strategy=broadcast" in plan  # the hits travel, not the texts


def test_words_of_a_search_by_one_pattern(spark):
    rng = random.Random(5)
    parts = ["heed", "Heed", "héed", "héed", "heeds", "xheed", "ﬁne", "fine", "the", "a", "7", "77", "ＨＥＥＤ", "Ⅷ", "½", "ß", "日本", " ", "-", "_", ".", "\n", "İ", "K"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))),) for _ in range(400)] + [(None,)]
    words = ["heed", "fine", "77", "the", "a", "k", "he-ed", "heeds"]
    df = spark.createDataFrame(rows, "x string").select("x", T.tokens_of(F.col("x"), words).alias("got"), F.filter(T.tokens(F.col("x"), exact=True), lambda w: w.isin(words)).alias("want")).collect()
    plain = [r for r in df if not re.search("[İⅧ]", r["x"] or "")]
    assert [r["got"] for r in plain] == [r["want"] for r in plain] and sum(len(r["got"]) for r in df) > 50
    docs = spark.createDataFrame([("r", 0, "", "heed")], "rec_id string, build_ord bigint, title string, text string")
    assert "lambda" not in search.postings(docs, ["heed", "anly"])._jdf.queryExecution().optimizedPlan().toString()
    assert [r["rec_id"] for r in search.search(docs, {1: "heed anly"}).collect()] == ["r"]


def test_records_are_parsed_once(spark):
    rows = [(json.dumps(RECORD | c), "With G7 the alarm is off.") for c in ({}, {"issue_id": True}, {"devices": "G7"}, {"devices": ["Zz 9"]}, {"confidence": 3}, {"fix": None})] + [("[1]", ""), ("{", ""), (None, None), ('{"title": 1}', "")]
    df = spark.createDataFrame(rows, "j string, t string")
    each = df.select("j", validate.record_errors(F.col("j"), F.col("t")).alias("errors"))
    once = validate.with_record_errors(df, F.col("j"), F.col("t"))
    assert [r["errors"] for r in once.collect()] == [r["errors"] for r in each.collect()]
    parses = [x._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") for x in (once, each)]
    assert parses[0] == 1 < parses[1], parses
