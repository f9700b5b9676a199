"""Behaviour of single operators on tiny frames."""

import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.functions import dates, jsons, progress, text, vectors
from quillsift.operators import attachments, chunking, enrichment, evals, indexing, model_calls, profiles, redaction, redaction_pass, search, search_index, status, triage, views
from quillsift.sources import mail, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---------------------------------------------------------------- functions


def test_text_functions(spark):
    assert one(spark, text.subject_family(F.lit("Re: Weekly Digest 2026-04-17 09:30 #981245"))) == "weekly digest"
    assert one(spark, text.subject_family(F.lit(None).cast("string"))) == "no subject"
    assert one(spark, text.sender_domain(F.lit("A@B.Example"))) == "b.example"
    assert one(spark, text.unsubscribe_host(F.lit("<mailto:x@y>, <https://u@list.example.com:8080/u>"))) == "u@list.example.com:8080"
    assert one(spark, text.truncate(F.lit("a  b " * 20), 10)) == "a b a b..."
    assert one(spark, text.truncate(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, text.strip_code_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, text.key_name(F.lit(" e-mail address "))) == "E_MAIL_ADDRESS"
    assert one(spark, text.unwrap(F.lit(' "(x  y)" '))) == "x y"
    assert one(spark, text.normalize_value(F.lit("PHONE"), F.lit("+1 (415) 555-1234"))) == "4155551234"
    assert one(spark, text.safe_extension(F.lit("a.PDF"), F.lit(None).cast("string"))) == ".pdf"
    assert one(spark, text.html_to_text(F.lit("<p>a &amp; b</p><script>x</script><p>c</p>"))) == "a & b\nc"
    assert one(spark, text.labels_from_options(F.array(F.lit("inbox, sent"), F.lit("Sent")))) == ["INBOX", "SENT"]
    assert one(spark, text.without_time_terms(F.lit("from:x before:2024/01/01 y"))) == "from:x y"
    assert one(spark, text.normalize_for_indexing(F.lit("a​\t b"), 3)) == "a b"


@pytest.mark.parametrize(("n", "letters"), [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (703, "AAA")])
def test_ordinals(spark, n, letters):
    assert one(spark, text.ordinal_letters(F.lit(n))) == letters
    assert one(spark, text.letters_ordinal(F.lit(letters))) == n


def test_dates(spark):
    r = one(spark, dates.date_range(F.lit("2026-03-05"), F.lit("2026-03-10")))
    assert (r.from_ms, r.to_ms, r.ok) == (1772668800000, 1773187200000, True)
    assert not one(spark, dates.date_range(F.lit("2026-03-10"), F.lit("2026-03-01"))).ok
    assert str(one(spark, dates.mail_date(F.lit("Mon, 04 Dec 2023 10:15:00 +0000"), F.lit(0)))) == "2023-12-04"
    assert str(one(spark, dates.mail_date(F.lit("nonsense"), F.lit(1700000000000)))) == "2023-11-14"
    assert one(spark, dates.before_term(F.lit(1700000000000))) == "before:2023/11/15"


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0, 0))) == -1.0
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == -1.0
    assert one(spark, vectors.cosine(F.lit(None).cast("array<double>"), v(1))) == -1.0


# ---------------------------------------------------------------- chunks, search, evaluation


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab \n", max_size=2500))
def test_chunks_cover(spark, body):
    got = one(spark, chunking.overlapping(F.lit(body), 300, 50))
    bare = body.strip(" ")
    for w in got:
        assert bare[w.start : w.end].strip(" ") == w.text and 0 < w.end - w.start <= 300
    assert not bare or not got or got[-1].end == len(bare)


def test_message_chunks(spark):
    m = spark.createDataFrame([("m", "Hi", "x" * 500), ("e", "", "")], "msg_id string, subject string, body_text string")
    rows = chunking.message_chunks(m, 300, 100).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.chunk_type) for r in rows] == [("e::c00000", "body"), ("m::c00000", "subject"), ("m::c00001", "body"), ("m::c00002", "body")]
    assert rows[0].chunk_text == "Body:"


def test_fusion_is_symmetric_and_adds(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "id long, score double")
    b = spark.createDataFrame([(2, 9.0), (3, 8.0)], "id long, score double")
    x = {r.id: r.score for r in search.fuse({"a": a, "b": b}).collect()}
    y = {r.id: r.score for r in search.fuse({"b": b, "a": a}).collect()}
    assert x == y and x[2] == pytest.approx(1 / 62 + 1 / 61)


def test_lexical_and_phrase(spark):
    d = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown the fox quick"), (3, "Élan vital")], "doc_id long, text string")
    assert [r.id for r in search.lexical(d, '"quick brown" fox').collect()] == [1]
    assert [r.id for r in search.lexical(d, "elan").collect()] == [3]
    assert search.lexical(d, "  ").count() == 0


def test_search_levels():
    assert search.level_for("redacted", "auto", 5, 5) == {"level": "redacted", "fallback": False}
    assert search.level_for("full", "auto", 0, 5) == {"level": "redacted", "fallback": True}
    with pytest.raises(ValueError):
        search.level_for("redacted", "full", 5, 5)


def test_evaluation_numbers(spark):
    ranks = spark.createDataFrame([(1, "m1", 1), (1, "m2", 2), (2, "m2", 1), (2, "m3", 2), (3, "x", 1), (3, "m4", 2)], "case_id long, msg_id string, rank int")
    relevant = spark.createDataFrame([(1, "m1"), (2, "m3"), (3, "m4")], "case_id long, msg_id string")
    r = evals.summary(evals.per_case(ranks, relevant, 2)).first()
    assert (r.cases, r.hit_rate_at_k, r.mrr, r.ndcg_at_k) == (3, 1.0, 0.666667, 0.753953)


# ---------------------------------------------------------------- triage, profiles


def test_triage(spark):
    rows = [
        ("d", "me@x.org", "news@list.example", "me@x.org", "Weekly Digest 2026-04-17", "", ["CATEGORY_PROMOTIONS"], {"list-id": "l", "list-unsubscribe": "<https://u.example/x>"}, 1),
        ("v", "me@x.org", "a@list.example", "me@x.org", "verify your sign-in", "", ["INBOX"], {"from": "a"}, 2),
        ("e", "me@x.org", "news@list.example", "me@x.org", "Re: Weekly Digest 2026-04-24", "", ["CATEGORY_PROMOTIONS"], {"list-id": "l", "list-unsubscribe": "<https://u.example/x>"}, 3),
    ]
    m = spark.createDataFrame(rows, "msg_id string, account_email string, from_addr string, to_addr string, subject string, snippet string, labels array<string>, headers map<string,string>, ts_ms long")
    got = {r.msg_id: r for r in triage.triaged(m, enforce=True).collect()}
    assert got["d"].triage_tier == "minimal" and got["d"].applied_tier == "light" and got["d"].bulk_score == 5
    assert got["v"].triage_tier == "full" and got["v"].importance_score == 3
    assert got["d"].stream_id == got["e"].stream_id != got["v"].stream_id
    assert (got["d"].novelty_score, got["e"].novelty_score) == (1.0, 0.0)
    assert {r.applied_tier for r in triage.triaged(m).collect()} == {"full"}


def test_profiles(spark):
    tier = lambda e, n, i, o, t="": one(spark, profiles.signal(F.lit(e), F.lit(n), F.lit(i), F.lit(o), F.lit(t))).tier
    assert tier("a@b.c", 1, 1, 0) == "quick"
    assert tier("a@b.c", 3, 3, 0) == "deep"
    assert tier("a@b.c", 1, 0, 1) == "deep"
    assert tier("updates@b.c", 3, 3, 0) == "quick"
    assert tier("noreply@b.c", 9, 9, 9) == "quick"
    assert one(spark, profiles.role(F.lit("x@y.z"), F.lit("your lease and the rent"))) == "landlord/property_manager"
    assert one(spark, profiles.role(F.lit("x@chase.com"), F.lit("hello"))) == "bank"
    assert one(spark, profiles.role(F.lit("x@y.z"), F.lit("apparently parents"))) == "contact"
    grown = lambda o, n: one(spark, profiles.grown(F.lit(o), F.lit(n), F.lit("quick"), F.lit("quick")))
    assert [grown(0, 1), grown(10, 12), grown(10, 13), grown(20, 24), grown(20, 25)] == [True, False, True, False, True]


def test_budget_skips_and_goes_on(spark):
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in (("a", 60), ("b", 60), ("c", 30))])
    got = one(spark, profiles.budgeted(items, 100, 5, lambda x: x["c"]))
    assert [r.k for r in got] == ["a", "c"]


def test_round_robin(spark):
    m = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("a3", "a"), ("b1", "b"), ("b2", "b"), ("b3", "b")], "id string, account string")
    assert [r.id for r in views.round_robin(m, "account", ["id"], 4).collect()] == ["a1", "b1", "a2", "b2"]


# ---------------------------------------------------------------- redaction


@pytest.mark.parametrize(
    ("key", "value", "source", "ok"),
    [
        ("EMAIL", "a@b.co", None, True), ("EMAIL", "name", None, False), ("PHONE", "415-555-1234", None, True), ("PHONE", "115-555-1234", None, False),
        ("PHONE", "415-155-1234", None, False), ("URL", "https://x.y/z", None, True), ("ACCOUNT", "12-34-56", None, True), ("ACCOUNT", "AB12", None, False),
        ("PERSON", "Jane Roe", None, True), ("PERSON", "Jane", None, False), ("PERSON", "Jenny", "First name: Jenny", True), ("PERSON", "Agent 7", None, False),
        ("ADDRESS", "CA", None, False), ("ADDRESS", "CA", "State: CA", True), ("ADDRESS", "12 Elm Street", None, True), ("CUSTOM", "jroe_42", None, True),
        ("CUSTOM", "hello", None, False), ("CUSTOM", "@handle", None, True), ("OTHER", "x", None, False), ("EMAIL", "a@b.co", "nothing here", False),
    ],
)
def test_validators(key, value, source, ok):
    assert redaction.allowed(key, value, source) is ok


def test_persistent_validators():
    assert not redaction.persistent("ADDRESS", "CA") and not redaction.persistent("PERSON", "name")
    assert redaction.persistent("PERSON", "Jenny") and redaction.persistent("ADDRESS", "PO Box 12")


def test_map_redaction():
    out, known = redaction.map_redact("mail a@b.co or A@B.co, call 415-555-1234, see https://x.y/z.")
    assert out == "mail <REDACTED_EMAIL_A> or <REDACTED_EMAIL_A>, call <REDACTED_PHONE_A>, see <REDACTED_URL_A>."
    again, _ = redaction.map_redact("c@d.co a@b.co", known)
    assert again == "<REDACTED_EMAIL_B> <REDACTED_EMAIL_A>"


def test_apply_longest_first_and_edges():
    entries = [("Jane", "<P_A>"), ("Jane Roe", "<P_B>")]
    assert redaction.apply_entries("Jane  Roe met Jane, not Janet", entries) == "<P_B> met <P_A>, not Janet"
    assert redaction.apply_entries("write to secret-va", [("secret-value", "<X>")], edges=True) == "write to <X>"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "c@d.org", "plain", "words", "https://x.y/z"]), max_size=12))
def test_redaction_round_trip(words):
    source = " ".join(words)
    entries = [(v, f"<REDACTED_{i}>") for i, v in enumerate(("a@b.co", "c@d.org", "https://x.y/z"))]
    out = redaction.apply_entries(source, entries)
    assert "@" not in out and redaction.undo_entries(out, entries) == source


def test_dictionary_keeps_old_placeholders(spark):
    schema = "doc_id long, scope string, key_name string, value string"
    first = spark.createDataFrame([(1, "s", "EMAIL", "b@x.co"), (2, "s", "EMAIL", "a@x.co")], schema)
    old = redaction.placeholder_dictionary(first, "scope", [F.col("doc_id")])
    more = spark.createDataFrame([(3, "s", "EMAIL", "0@x.co"), (4, "s", "EMAIL", "A@X.co"), (5, "t", "EMAIL", "a@x.co")], schema)
    new = {(r.scope, r.value_norm): r.placeholder for r in redaction.placeholder_dictionary(more, "scope", [F.col("doc_id")], existing=old).collect()}
    assert new == {("s", "b@x.co"): "<REDACTED_EMAIL_A>", ("s", "a@x.co"): "<REDACTED_EMAIL_B>", ("s", "0@x.co"): "<REDACTED_EMAIL_C>", ("t", "a@x.co"): "<REDACTED_EMAIL_A>"}


def test_entries_merge_and_prune(spark):
    e = spark.createDataFrame([("s", "PERSON", "v1", "<A>", "One Name", 1, 1, "active"), ("s", "PERSON", "v2", "<A>", "Two Name", 1, 2, "active")], "scope_id string, key_name string, value_norm string, placeholder string, original_value string, hit_count long, last_seen_at long, status string")
    r = redaction.merged_entries(e).collect()
    assert len(r) == 1 and r[0].value_norm == "v2" and r[0].hit_count == 2
    bad = spark.createDataFrame([("ADDRESS", "CA", "active"), ("EMAIL", "a@b.co", "active")], "key_name string, original_value string, status string")
    assert {x.key_name: x.status for x in redaction.pruned_entries(bad).collect()} == {"ADDRESS": "rejected", "EMAIL": "active"}


def test_model_pairs(spark):
    got = one(spark, redaction.model_pairs(F.lit('{"email": ["a@b.co", "c@d.co"], "person": "Jane Roe"}')))
    assert {(r.key_name, r.value) for r in got} == {("EMAIL", "a@b.co"), ("EMAIL", "c@d.co"), ("PERSON", "Jane Roe")}


# ---------------------------------------------------------------- sources, tables, indexing


def payload(spark, tmp_path):
    b = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    h = lambda *kv: [{"name": k, "value": v} for k, v in kv]
    m = {
        "id": "m1", "threadId": "t", "historyId": "7", "internalDate": "1700000000000", "labelIds": ["INBOX"], "snippet": "snip",
        "payload": {"mimeType": "multipart/mixed", "headers": h(("From", "a@b.co"), ("Date", "Mon, 04 Dec 2023 10:15:00 +0000"), ("Subject", "Hi")), "parts": [
            {"partId": "0", "mimeType": "multipart/alternative", "parts": [{"partId": "0.0", "mimeType": "text/plain", "body": {"data": b("héllo?>")}}, {"partId": "0.1", "mimeType": "text/html", "body": {"data": b("<p>x</p>")}}]},
            {"partId": "1", "mimeType": "text/plain", "filename": "a.txt", "body": {"attachmentId": "A", "size": 3, "data": b("not body")}},
            {"partId": "2", "mimeType": "image/png", "filename": "i.png", "headers": h(("Content-ID", "<c>")), "body": {"attachmentId": "B", "size": 9}},
        ]},
    }
    (tmp_path / "p.json").write_text(json.dumps(m) + "\nnot json\n")
    return mail.read_payloads(spark, str(tmp_path))


def test_payloads(spark, tmp_path):
    p = payload(spark, tmp_path)
    m = mail.messages(p, "me@x.org").first()
    assert (m.msg_id, m.body_text, m.subject, str(m.date_iso), m.history_id) == ("m1", "héllo?>", "Hi", "2023-12-04", 7)
    a = mail.attachments(p).orderBy("part_id").collect()
    assert [(r.part_id, r.is_inline) for r in a] == [("1", False), ("2", True)]
    assert bytes(mail.inline_bytes(p).first().content) == b"not body"


def test_change_feed(spark, tmp_path):
    page = lambda i, *ms: json.dumps({"historyId": str(i), "history": [{"messagesAdded": [{"message": {"id": m, "labelIds": [label]}} for m, label in ms]}]})
    (tmp_path / "1.json").write_text(page(5, ("a", "INBOX"), ("b", "CATEGORY_UPDATES")) + "\n" + page(6, ("a", "INBOX"), ("c", "SENT")))
    spark.dataSource.register(mail.ChangeFeed)
    q = spark.readStream.format("mail_changes").option("path", str(tmp_path)).option("start", "0").load().writeStream.format("memory").queryName("feed").start()
    q.processAllAvailable()
    q.stop()
    assert {r.msg_id for r in spark.table("feed").collect()} == {"a", "c"}


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, ver long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k long, v string, ver long")
    store = tables.Catalog(spark, f"file://{tmp_path}")
    assert store.read("t") is None
    for _ in range(2):
        store.upsert("t", old, ["k"], "ver")
        store.upsert("t", new, ["k"], "ver")
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    parts = spark.createDataFrame([("m", "0", "done"), ("m", "1", "done"), ("n", "0", "done")], "msg_id string, part_id string, state string")
    fresh = spark.createDataFrame([("m", "0")], "msg_id string, part_id string")
    got = tables.replaced(parts, fresh, "msg_id", "part_id", ["state"])
    assert sorted((r.msg_id, r.part_id, r.state) for r in got.collect()) == [("m", "0", "done"), ("n", "0", "done")]


def test_materialize(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", bytearray(b"xyz"))], "path string, content binary")
    r = tables.materialize(rows, f"file://{tmp_path}").first()
    assert (tmp_path / "a/b.txt").read_bytes() == b"xyz" and r.content_size_bytes == 3


def test_index_is_incremental(spark):
    rows = [("m1", "s", "", "body", ["INBOX"], 1), ("m2", "s", "", "", ["SPAM"], 2), ("m3", "t", "", "c", ["INBOX"], 3)]
    m = spark.createDataFrame(rows, "msg_id string, subject string, snippet string, body_text string, labels array<string>, internal_ts long")
    p = indexing.prepared(m, exclude=("spam",))
    state = spark.createDataFrame([], "msg_id string, content_hash string, redaction_policy_version string")
    assert [r.msg_id for r in indexing.pending(p, state, 1).collect()] == ["m3"]
    done = p.select("msg_id", "content_hash", F.lit(redaction.POLICY).alias("redaction_policy_version"))
    assert indexing.pending(p, done).count() == 0
    assert indexing.pending(p, done.withColumn("redaction_policy_version", F.lit("old"))).count() == 2


def test_embedding_batches(spark):
    def service(texts):
        if len(texts) > 1:
            raise ValueError("too large")
        return [[float(len(texts[0])), 1.0]]

    d = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(5)], "i int, t string").coalesce(1)
    got = d.select("i", indexing.embed_with(service)(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v[0] for r in got] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_history_gap(spark):
    c = spark.createDataFrame([("a", 9), ("b", 3)], "account_email string, history_id long")
    m = spark.createDataFrame([("a", 5), ("c", 1)], "account_email string, history_id long")
    assert {r.account_email: r.gap for r in status.history_gap(c, m).collect()} == {"a": 4, "b": 0, "c": 0}


def test_accounts_and_addresses_by_form():
    from quillsift.operators import validators

    assert validators.remap("CUSTOM", "A123456") == "CUSTOM"
    assert validators.remap("CUSTOM", "AB12345678") == "ACCOUNT"
    text = "Sent to 12 Main Street, Springfield"
    assert validators.expand_address("12 Main Street, Springfield", text) == ["12 Main Street, Springfield"]
    assert validators.expand_address("12 Main Street, Shelbyville", text) == ["12 Main Street", "12", "Main Street"]
    assert validators.expand_address("", text) == []


@pytest.mark.parametrize(
    "value, ok",
    [("@jane_d", True), ("@ab", False), ("jdoe99", True), ("ab12", False), ("Ab12", True), ("foo.bar", True), ("Foo-Bar", False), ("fooBar", True), ("foobar", False), ("user12", False), ("two words1", False)],
)
def test_handles(value, ok):
    assert redaction.allowed("CUSTOM", value) is ok


def test_model_reply(spark):
    reply = 'Sure:\n```json\n{"redactions": [{"key_name": "person", "values": ["Jane Roe", " "]}, {"key_name": "EMAIL", "values": "a@b.co"}]}\n```'
    got = one(spark, redaction.model_pairs(F.lit(reply)))
    assert [(x.key_name, x.value) for x in got] == [("PERSON", "Jane Roe"), ("EMAIL", "a@b.co")]


# ---------------------------------------------------------------- persisted index, passes, model calls

MESSAGE = "msg_id string, subject string, snippet string, body_text string, account_email string, labels array<string>, internal_ts long"


def test_index_levels_filters_and_runs(spark, tmp_path):
    rows = [("a", "Rent", "", "write to bob@example.com about rent", "x", ["INBOX"], 100), ("b", "Rent again", "", "rent is due", "y", ["SENT"], 200), ("c", None, None, None, "x", [], None), (None, "Rent", "", "rent", "x", [], 1)]
    m = spark.createDataFrame(rows, MESSAGE)
    root = f"file://{tmp_path}/index"
    low, full = search_index.SearchIndex(spark, root, "redacted"), search_index.SearchIndex(spark, root, "full")
    with pytest.raises(ValueError):
        search_index.searched(spark, root, "rent")
    assert (low.add(m), low.add(m), full.add(m)) == (3, 0, 3)
    ids = lambda df: [r.id for r in df.collect()]
    assert set(ids(low.lexical("rent"))) == {"a", "b"} and ids(low.lexical("rent", account="y")) == ["b"]
    assert ids(low.lexical("rent", label="inbox")) == ["a"] and ids(low.lexical("rent", start=100, end=200)) == ["a"]
    assert ids(low.lexical('"rent is"')) == ["b"] and ids(low.lexical("  ")) == []
    # an address can't be confirmed without clearance
    assert ids(low.lexical("bob")) == [] and ids(full.lexical("bob")) == ["a"]
    assert [r.used_level for r in search_index.searched(spark, root, "bob", clearance="full", strategy="lexical").collect()] == ["full"]
    shown = search_index.searched(spark, root, "rent", k=2).collect()
    assert {r.used_level for r in shown} == {"redacted"} and all("bob@" not in r.preview for r in shown)
    with pytest.raises(ValueError):
        search_index.searched(spark, root, "bob", level="full")
    # a changed message is read from its new segment alone
    changed = m.filter("msg_id = 'b'").withColumn("body_text", F.lit("other words")).withColumn("subject", F.lit(""))
    assert low.add(changed) == 1 and set(ids(low.lexical("rent"))) == {"a"} and ids(low.lexical("other")) == ["b"]
    assert low.state().count() == 3


def test_search_ranks_redacted_text(spark):
    d = spark.createDataFrame([(1, "write to bob@example.com", "s", "en"), (2, "nothing", "s", "en")], "doc_id long, text string, source string, lang string")
    assert search.search(d, None, "bob", strategy="lexical").count() == 0
    assert [r.id for r in search.search(d, None, "bob", strategy="lexical", clearance="full").collect()] == [1]


def test_redact_pass_and_map(spark):
    m = spark.createDataFrame([("a", "mail ann@example.com or ann@example.com", "x"), ("b", None, "x")], "msg_id string, text string, account_email string")
    chunks = spark.createDataFrame([("a0", "a", "mail ann@exam"), ("a1", "a", "see bob@example.org"), ("b0", "b", None)], "chunk_id string, msg_id string, chunk_text string")
    words, whole, parts = redaction_pass.redact_pass(m, chunks)
    assert {(r.value_norm, r.placeholder) for r in words.collect()} == {("ann@example.com", "<REDACTED_EMAIL_A>"), ("bob@example.org", "<REDACTED_EMAIL_B>")}
    assert {r.msg_id: r.redacted for r in whole.collect()} == {"a": "mail <REDACTED_EMAIL_A> or <REDACTED_EMAIL_A>", "b": ""}
    assert {r.chunk_id: r.redacted for r in parts.collect()} == {"a0": "mail <REDACTED_EMAIL_A>", "a1": "see <REDACTED_EMAIL_B>", "b0": ""}
    _, known = redaction.map_redact("ann@example.com and https://x.example/a.")
    assert redaction_pass.map_from_json(redaction_pass.map_to_json(known, "s")) == known
    assert redaction_pass.map_from_json("[1") == {} and redaction_pass.map_from_json(None) == {}


def test_model_redaction_in_pieces(spark):
    d = spark.createDataFrame([("a", "abcdefgh"), ("b", "to x@y.example"), ("c", None)], "msg_id string, text string")
    model = lambda c: F.when(~F.contains(c, F.lit("@")), F.concat(F.lit("```\n"), F.upper(c), F.lit("\n```")))
    assert {r.msg_id: r.redacted for r in redaction_pass.model_redacted(d, model, 100).collect()} == {"a": "ABCDEFGH", "b": "to [REDACTED_EMAIL]", "c": ""}
    assert redaction_pass.model_redacted(d.filter("msg_id = 'a'"), model, 3).first().redacted == "ABCDEFGH"


def test_model_calls():
    class Busy(Exception):
        code = 429

    waits, tries = [], []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise Busy
        return x

    assert model_calls.retrying(call, sleep=waits.append)("p") == "p" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        model_calls.retrying(lambda: 1 / 0, sleep=waits.append)()
    contract = model_calls.missing_text("category")
    said = iter(["no", '{"category": " "}', 'well {"category": "a"}'])
    assert json.loads(model_calls.json_answer(lambda p: next(said), "full", "short", contract)) == {"category": "a"}
    assert json.loads(model_calls.json_answer(lambda p: '{"category": "b"}' if p == "short" else "", "full", "short", contract)) == {"category": "b"}
    assert model_calls.json_answer(lambda p: 1 / 0, "full", "short", contract) is None


def test_enrichment_by_service(spark):
    m = spark.createDataFrame([("a", "Rent", "s", "b"), ("b", "Hi", "s", "b")], "msg_id string, subject string, snippet string, body_text string")
    call = lambda p: '{"category": "home", "summary": "x", "importance": "99"}' if "Rent" in p else "?"
    got = {r.msg_id: r for r in enrichment.answered(m, call).collect()}
    assert (got["a"].category, got["a"].importance, got["a"].model) == ("home", 10, "model")
    assert (got["b"].category, got["b"].model) == ("general", enrichment.FALLBACK)


def test_meta_and_counters(spark):
    meta = lambda p, m: tuple(one(spark, jsons.existing_meta(F.lit(p).cast("string"), F.lit(m).cast("string"))))
    assert meta(None, None) == ("heuristic", "quick", 0) and meta("{", "m") == ("llm", "deep", 0)
    assert meta('{"_meta": {"source": "heuristic", "evidence_count": "x"}}', "m") == ("heuristic", "quick", 0)
    assert meta('{"_meta": {"tier": "deep", "evidence_count": 4}}', None) == ("heuristic", "deep", 4)
    rows, seen = progress.observed(spark.range(10), even=F.count_if(F.col("id") % 2 == 0))
    rows.collect()
    assert seen.get == {"rows": 10, "even": 5}


def test_attachments_are_written_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    a = spark.createDataFrame([("k1", "attachments/0/k1.txt"), ("k2", "attachments/0/k2.txt"), (None, "x")], "attachment_key string, path string")
    inline = spark.createDataFrame([("k1", bytearray(b"one")), ("k2", None)], "attachment_key string, content binary")
    assert [(r.path, r.content_size_bytes) for r in attachments.write_missing(spark, a, inline, root).collect()] == [("attachments/0/k1.txt", 3)]
    stored = attachments.stored_files(spark, root)
    assert attachments.write_missing(spark, a, inline, root, stored).count() == 0
    assert bytes(attachments.file_bytes(spark, root).first().content) == b"one"


def test_cases_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "msg_id long, embedding array<double>")
    cases = v.filter("msg_id < 7").select(F.col("msg_id").alias("case_id"), F.col("embedding").alias("q"))
    got = lambda block: sorted(map(tuple, evals.in_blocks(cases, v, 5, block).collect()))
    assert got(2) == got(100) and len(got(2)) == 35


def test_cases_in_blocks_as_pair_by_pair(spark):
    """Against cosine() on every pair: copies, scaled vectors, other lengths, zero, null and absent elements, NaN."""
    import random

    from pyspark.sql import Window

    from quillsift.functions.vectors import cosine

    r = random.Random(5)
    rows = [[r.choice([-1.0, 0.0, 0.5, 1.0]) * r.random() for _ in range(4)] for _ in range(300)]
    rows += [rows[3]] * 40 + [[2 * x for x in rows[4]]] * 9 + [[1.0, 2.0], [0.0] * 4, None, [], [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 0.0, 0.0]]
    v = spark.createDataFrame([((i * 7919) % 1009, x) for i, x in enumerate(rows)], "msg_id long, embedding array<double>")
    cases = v.select(F.col("msg_id").alias("case_id"), F.col("embedding").alias("q"))
    scored = cases.crossJoin(v).select("case_id", "msg_id", F.round(cosine("q", "embedding"), 9).alias("score"))
    wanted = scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "msg_id"))).filter("rank <= 7").drop("score")
    found = evals.in_blocks(cases, v, 7, 100)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan


def test_cases_in_blocks_in_time(spark):
    """2,000 cases against 20,000 vectors: pair by pair that takes many minutes."""
    import time

    v = spark.range(20_000).select(F.col("id").alias("msg_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    cases = v.filter("msg_id % 10 = 0").select(F.col("msg_id").alias("case_id"), F.col("embedding").alias("q"))
    began = time.time()
    assert evals.in_blocks(cases, v, 3).count() == 6000 and time.time() - began < 60


def test_cases_in_blocks_of_extreme_norms(spark):
    """Products of such norms leave the range of double; the score is then another than that of the unit vectors."""
    import random

    from pyspark.sql import Window

    from quillsift.functions.vectors import cosine

    r = random.Random(7)
    rows = [[(r.random() - 0.5) * scale for _ in range(4)] for scale in (1.0, 1e-158, 1e-161, 1e155, 1e200) for _ in range(40)]
    v = spark.createDataFrame(list(enumerate(rows)), "msg_id long, embedding array<double>")
    cases = v.filter("msg_id % 3 = 0").select(F.col("msg_id").alias("case_id"), F.col("embedding").alias("q"))
    scored = cases.crossJoin(v).select("case_id", "msg_id", F.round(cosine("q", "embedding"), 9).alias("score"))
    wanted = scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "msg_id"))).filter("rank <= 5").drop("score")
    assert sorted(map(tuple, evals.in_blocks(cases, v, 5).collect())) == sorted(map(tuple, wanted.collect()))


def test_cases_meet_a_batch_at_once(monkeypatch):
    """What is found is merged once a batch and not once for each part of the cases."""
    import numpy as np
    import pyarrow as pa

    x = np.random.default_rng(3).standard_normal((6000, 8))
    ids, vectors = pa.array(range(6000), pa.int64()), pa.array(list(x))
    sorts, real = [], evals.pc.array_sort_indices
    monkeypatch.setattr(evals.pc, "array_sort_indices", lambda *a, **b: sorts.append(len(a[0])) or real(*a, **b))
    batches = pa.table({"msg_id": ids, "embedding": vectors}).to_batches(max_chunksize=2000)
    (found,) = evals.first_of(ids.slice(0, 2048), vectors.slice(0, 2048), 3, 9)(iter(batches))
    assert found.num_rows == 3 * 2048 and len(sorts) == 2 * len(batches)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    best = np.sort(np.argsort(-(unit[:2048] @ unit.T), axis=1, kind="stable")[:, :3], axis=1)
    got = np.sort(np.array(found.column(1).to_pylist())[np.lexsort((found.column(1).to_pylist(), found.column(0).to_pylist()))].reshape(-1, 3), axis=1)
    assert (got == best).all()
