"""Readers on small files."""

from evidentia.sources.chat_export import messages
from evidentia.sources.records import json_lines, mailbox, mails, measurements


def test_chat_export(spark):
    lines = ["preface", "01/02/2024, 10:15 - Ann: hello", "second line", "01/02/2024, 10:15 - +44 (770) 090-0123: hi", "[01/02/2024, 9:05:07 PM] Bob: late", "01/02/2024, 10:15 - Ann: hello", "second line", "01.02.24, 10:16 - no sender here", "31/02/2024, 10:00 - Ann: never"]
    rows = messages(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")).orderBy("message_no").collect()
    assert [(r.sender, r.text, r.ordinal) for r in rows] == [("Ann", "hello\nsecond line", 0), ("+44 (770) 090-0123", "hi", 0), ("Bob", "late", 0), ("Ann", "hello\nsecond line", 1), (None, "no sender here", 0), ("Ann", "never", 0)]
    assert str(rows[0].sent_at) == "2024-02-01 10:15:00" and str(rows[2].sent_at) == "2024-02-01 21:05:07"
    assert (rows[1].namespace, rows[1].address, rows[0].namespace) == ("phone", "+447700900123", "label:f") and rows[5].error == "no such date"


def test_what_is_no_header(spark):
    lines = ["1.2.24, 9:05 - A: x", "[1.2.24, 9:05", "[1.2.24, 9:05 - y", "1.2.24 9:05:07 am - B: z - z ] -] w", "1.2, 9:05 - A: n", "1.2.24, 9 - A: n", "a.2.24, 9:05 - A: n", "9:05 - A", "[] x", "", "\u200e[1.2.24, 9:05\u202fPM] C: [k] - l"]
    rows = messages(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")).orderBy("message_no").collect()
    assert [(r.sender, r.text) for r in rows] == [("A", "\n".join(["x", *lines[1:3]])), ("B", "\n".join(["z - z ] -] w", *lines[4:10]])), ("C", "[k] - l")]
    assert [str(r.sent_at) for r in rows] == ["2024-02-01 09:05:00", "2024-02-01 09:05:07", "2024-02-01 21:05:00"]


def test_clock_changes(spark):
    lines = ["2024-03-31, 02:30 - A: gap", "2024-10-27, 02:30 - A: twice", "2024-07-01, 12:00 AM - A: summer", "2024-01-01, 12:00 - A: winter"]
    frame = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    rows = messages(frame, dates="YMD", zone="Europe/Berlin").orderBy("message_no").collect()
    assert rows[0].error == "no such time in the zone" and rows[0].sent_at is None
    assert [str(r.sent_at) for r in rows[1:]] == ["2024-10-27 00:30:00", "2024-06-30 22:00:00", "2024-01-01 11:00:00"] and [r.ambiguous for r in rows] == [False, True, False, False]
    assert str(messages(frame, dates="YMD", zone="Europe/Berlin", fold=1).where("message_no = 2").first().sent_at) == "2024-10-27 01:30:00"


def test_json_lines(spark, tmp_path):
    good = '{"schema_version":"1.0","source":"s","source_id":"1","revision":"1","kind":"k","observed_at":"2024-01-01T00:00:00+01:00","text":"t","provenance":{"origin":"source"}}'
    (tmp_path / "a.jsonl").write_text(good + "\n\n{broken\n")
    rows = json_lines(spark, str(tmp_path / "a.jsonl")).collect()
    assert sorted(r.valid for r in rows) == [False, True]


def test_measurements(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,metric,value,unit,id,device\n2024-01-01T00:00:00Z,mass,70.5,kg,1,x\n2024-01-01T00:00:00Z,mass,NaN,kg,2,x\n2024-01-01T00:00:00,mass,1,kg,3,x\n")
    rows = {r.id: r for r in measurements(spark, str(tmp_path / "a.csv")).collect()}
    assert float(rows["1"].value) == 70.5 and rows["1"].error is None
    assert rows["2"].error == "value" and rows["3"].error == "timestamp"


def test_mails(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: A <a@x.org>\r\nTo: b@x.org, C <c@x.org>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0000\r\nSubject: s\r\n\r\nbody\r\n")
    (tmp_path / "b.eml").write_bytes(b"From: a@x.org\r\nDate: Mon, 01 Jan 2024 10:00:00\r\n\r\nbody\r\n")
    rows = {r.path[-5:]: r for r in mails(spark, str(tmp_path)).collect()}
    assert rows["a.eml"].receivers == ["b@x.org", "c@x.org"] and rows["a.eml"].body.strip() == "body"
    assert rows["b.eml"].error == "date without zone"


def test_mailbox(spark, tmp_path):
    text = "From a@x.org Mon Jan  1 10:00:00 2024\nFrom: a@x.org\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nSubject: one\n\n>From here\n\nFrom b@x.org Tue Jan  2 10:00:00 2024\nFrom: b@x.org\nContent-Type: text/html\nSubject: two\n\n<p>x<br>y</p>\n"
    (tmp_path / "a.mbox").write_text(text)
    rows = {r.subject: r for r in mailbox(spark, str(tmp_path / "a.mbox")).collect()}
    assert rows["one"].body.strip() == "From here" and rows["one"].senders == ["a@x.org"] and rows["two"].body == "x\ny"


ODD_PAGES = [
    "a &amp b &ampc &lt;i&gt; &eacute; &#65; &nbsp; &AMP; &amp;lt; &amp;amp; &amp;quot; &quot;&copy &middot;", "<a title='x>y'>z</a><br alt=\"p>q\">r", "x &amp",
    "<script a='>'>b</script >c<SCRIPT>d</Script>e<ſcript>f</ſcript>g", "<scriptä>h</script>i<scripty>j</scripty>k", "<style>l</styleä>m", "<pä>n<pre>o</pre><p_>p<P>q<DIV>r<Lı>s",
    "\x0b t \x0b", " u ", "v  ", "w \u0085", "\t\f\r\n x\n\n", "<!-- y", "z<!--a-->b<!--c--->d-->", "e<!doctype>f<?x?>g<!h", "1 < 2 > 3 <4> </> <b", "<p", "", None, "&" * 50 + "amp;",
    "i\r\nj\rk", "<style>never", "<ſtyle>l</STYLE>m", "From x\n.\n\n--b\nContent-Type: text/plain\n\nn", "\ufeffo \x00p", "q" + " " * 50_000 + "r",
]


def _pages(spark, folder, more=()):
    spark.createDataFrame([*enumerate(ODD_PAGES), *more], "page_id long, html string").selectExpr("page_id", "concat('u', page_id) AS url", "html").coalesce(1).write.parquet(str(folder / "x"))
    next((folder / "x").glob("*.parquet")).rename(folder / "pages.parquet")
    return str(folder)


def _against_sql(spark, folder, name):
    from evidentia.plans import ORACLES, QUERIES

    from oracle import connection

    want = connection(folder).sql(ORACLES[name])
    found = {r.page_id: tuple(r[c] for c in want.columns) for r in QUERIES[name](spark, folder).collect()}
    rows = want.fetchall()
    assert len(rows) == len(found)
    for row in rows:
        assert found[row[0]] == row


def test_html_text_as_in_sql(spark, tmp_path):
    _against_sql(spark, _pages(spark, tmp_path), "src_13_html_text")


def test_mails_as_in_sql(spark, tmp_path):
    _against_sql(spark, _pages(spark, tmp_path, [(None, "<p>no number")]), "src_09_mails")
