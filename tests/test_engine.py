import datetime as dt
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallygrove import schemas, storage
from tallygrove.functions import vectors as V
from tallygrove.operators import chunking, flows, index, ingest, limits, listing, metrics, retrieval
from tallygrove.operators.listing import Filters
from tallygrove.plans.api import NotFound, Service
from tallygrove.sources import boards, files, liveness, search

NOW = dt.datetime(2026, 1, 31)


def listings(spark, rows):
    names = [c.split(" ")[0] for c in schemas.LISTING.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.LISTING)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def pair(spark):
    return listings(
        spark,
        [
            dict(id=1, source_job_id="a", title="Backend Engineer", company="Acme Corp", work_mode="remote", experience_level="entry", visa_sponsorship=True, salary_min=9e4, salary_max=1.1e5, required_skills=["python", "sql"], posted_at=NOW, start_date_text="Summer 2026"),
            dict(id=2, source_job_id="b", title="Frontend Developer", company="Globex", work_mode="onsite", experience_level="senior", visa_sponsorship=False, salary_min=1.3e5, salary_max=1.6e5, required_skills=["javascript", "react"], posted_at=NOW - dt.timedelta(days=31)),
            dict(id=3, source_job_id="synthetic-1", title="50% off_ice", company="Initech"),
        ],
    )


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        (dict(), [1, 2, 3]),
        (dict(search=" BACKEND "), [1]),
        (dict(search="b_ckend"), [1]),
        (dict(search="0%f"), [3]),
        (dict(skills=("java",)), [2]),
        (dict(skills=("python,sql",)), [1]),
        (dict(visa_only=True), [1]),
        (dict(salary_min=100_000), [2]),
        (dict(salary_max=120_000), [1, 3]),
        (dict(salary_max=300_000), [1, 2, 3]),
        (dict(work_modes=("onsite", "remote"), experience_levels=("senior",)), [2]),
        (dict(date_posted="24h", now=NOW), [1]),
        (dict(date_posted="whenever", now=NOW), [1]),
        (dict(seasons=("summer", "fall")), [1]),
    ],
)
def test_filters(pair, filters, expected):
    assert ids(listing.filtered(pair, Filters(**filters))) == expected


def test_pages(pair):
    assert [r.id for r in listing.page_of(pair, Filters(), "salary", 1, 2).collect()] == [2, 1]
    assert [r.id for r in listing.page_of(pair, Filters(), "relevant", 1, 3).collect()] == [1, 2, 3]
    assert listing.page_of(pair, Filters(), "newest", 9).count() == 0
    assert listing.totals(pair, Filters(search="none"), 20).first().asDict() == {"total": 0, "total_pages": 1}
    with pytest.raises(ValueError, match="page"):
        listing.page_of(pair, Filters(), page=0)


def test_top_k_is_one_operator(pair):
    plan = listing.page_of(pair, Filters(salary_min=1), "salary", 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_insert_if_absent(spark):
    batch = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("", 3, "z"), (None, 4, "z"), ("s", 5, "z"), ("c", 6, "w")], "source_job_id string, n int, v string")
    stored = spark.createDataFrame([("s",)], "source_job_id string")
    new = ingest.insert_if_absent(batch, stored, "n")
    assert sorted((r.source_job_id, r.v) for r in new.collect()) == [("a", "x"), ("c", "w")]
    assert ingest.insert_counts(batch, new).first().asDict() == {"saved": 2, "skipped": 4}
    assert sorted(r.id for r in ingest.with_ids(new, 10, ["n"]).collect()) == [11, 12]


def test_staged_and_reparsed(spark):
    names = [c.split(" ")[0] for c in schemas.RAW.split(", ")]
    row = dict(job_id="1", job_title="Senior Data Engineer in Austin, TX", job_description="Requirements\n- Python and Spark, several years\nPay: $100,000 - $150,000 per year. We sponsor.", job_is_remote=True)
    raw = spark.createDataFrame([tuple(row.get(n) for n in names)], schemas.RAW)
    out = ingest.staged(raw, "lever")
    assert [f.name for f in out.schema.fields] == [c.split(" ")[0] for c in schemas.STAGED.split(", ")]
    r = out.first()
    assert (r.city, r.state, r.country, r.salary_min, r.salary_max, r.salary_period, r.salary_currency) == ("Austin", "TX", "US", 1e5, 1.5e5, "YEAR", "USD")
    assert (r.work_mode, r.experience_level, r.visa_sponsorship, r.company, r.required_skills) == ("remote", "senior", True, "N/A", ["python", "spark"])
    assert ingest.reparse_counts(ingest.reparsed(out)).first().asDict() == {"updated": 0, "unchanged": 1, "total": 1}


def test_boards(spark, tmp_path):
    (tmp_path / "lever.json").write_text(json.dumps([{"id": "9", "text": "Backend Engineer", "createdAt": 1700000000000, "categories": {"commitment": "Intern", "location": "Remote, US"}, "descriptionPlain": "Hello", "lists": [{"text": "Needs", "content": "<li>Rust &amp; Go"}]}]))
    r = boards.read(spark, "lever", str(tmp_path / "lever.json"), "palantir").first()
    assert (r.job_id, r.employer_name, r.job_is_remote, r.job_employment_types) == ("lever-9", "Palantir", True, ["INTERN"])
    assert r.job_description == "Hello\n\n\nNeeds\n- Rust & Go"
    assert r.job_posted_at_datetime_utc.startswith("2023-11-14T22:13:20")
    (tmp_path / "ashby.json").write_text(json.dumps({"jobs": [{"id": "7", "title": "SRE", "employmentType": "Full Time", "descriptionHtml": "<p>x</p>", "location": "Oslo"}]}))
    r = boards.read(spark, "ashby", str(tmp_path / "ashby.json"), "unknown").first()
    assert (r.job_id, r.employer_name, r.job_employment_types, r.job_description) == ("ashby-7", "Unknown", ["FULLTIME"], "x")
    (tmp_path / "gh.json").write_text(json.dumps({"jobs": [{"id": 5, "title": "Cook", "updated_at": "2025-01-01", "location": {"name": "remote"}, "content": "&lt;p&gt;y&lt;/p&gt;"}]}))
    df = boards.read(spark, "greenhouse", str(tmp_path / "gh.json"), "gitlab")
    r = df.first()
    assert (r.job_id, r.employer_name, r.job_posted_at_datetime_utc, r.job_is_remote, r.job_description) == ("greenhouse-5", "GitLab", "2025-01-01", True, "y")
    assert boards.wanted(df, spark.createDataFrame([("z",)], "source_job_id string")).count() == 0


def client(query, page):
    pages = {1: (200, {"data": [{"job_id": f"{query}1", "job_title": "Data Engineer", "job_apply_link": "http://x"}]}), 2: (429, {"message": "slow down"}), 3: (200, {"data": [{"job_id": f"{query}3", "job_title": "Cook"}, {"job_id": "known"}]})}
    return pages.get(page, (200, {"data": []}))


def test_search_feed(spark):
    assert [r["job_id"] for r in search.pages(client, "q", {"known"}, 9)[0]] == ["q1", "q3"]
    assert search.pages(lambda q, p: (429, {"message": "Monthly quota"}), "q", set(), 3) == ([], True)
    spark.dataSource.register(search.SearchFeed)
    df = spark.read.format("search_feed").option("client", "tests.test_engine:client").option("queries", '["a", "b"]').option("known", '["known"]').load()
    assert sorted(r.job_id for r in df.collect()) == ["a1", "a3", "b1", "b3"]
    assert sorted(r.job_id for r in search.wanted(df).collect()) == ["a1", "b1"]


def scarce(query, page):
    """The quota is used up by the third page of "first"; each page that is asked for leaves a file."""
    Path(os.environ["ASKED_PAGES"], f"{query}-{page}").touch()
    if query == "first" and page == 3:
        return 429, {"message": "You have exceeded the monthly QUOTA"}
    return 200, {"data": [{"job_id": f"{query}{page}", "job_title": "Software Engineer", "job_apply_link": "http://x"}]}


def test_quota_of_one_query_stops_the_others(spark, tmp_path):
    os.environ["ASKED_PAGES"] = str(tmp_path)
    module = f"{__name__}:scarce"
    known = spark.createDataFrame([("old9",), ("third1",), (None,)], "source_job_id string")
    quota, ids = search.Quota(storage.new_path(spark, "quota")), search.StoredIds(search.stored_ids(known))
    assert not quota.met() and ids.intersection(["third1", None, "x"]) == {"third1"} and ids.intersection([]) == set()
    one = search.pages(scarce, "first", ids, 9, stopped=quota.met)
    assert [r["job_id"] for r in one[0]] == ["first1", "first2"] and one[1]
    quota.note()
    assert quota.met() and search.pages(scarce, "second", ids, 9, stopped=quota.met) == ([], False)
    assert search.pages(scarce, "third", ids, 9) == ([], False)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["first-1", "first-2", "first-3", "third-1"]
    # As Spark reads it: the first query meets the quota in its task, what it had is kept, and the source says so.
    os.environ.pop("ASKED_PAGES")
    fetch = search.fetched(spark, "tests.test_engine:quota_client", ["first", "third"], "feed")
    rows, met = fetch(known)
    assert met and sorted(r.source_job_id for r in rows.collect()) == ["first1", "first2"]
    rows, met = search.fetched(spark, "tests.test_engine:quota_client", ["second"], "feed", 2)(known.limit(0))
    assert not met and sorted((r.source_job_id, r.source) for r in rows.collect()) == [("second1", "feed"), ("second2", "feed")]


def quota_client(query, page):
    if query == "first" and page == 3:
        return 429, {"message": "quota"}
    return 200, {"data": [{"job_id": f"{query}{page}", "job_title": "Software Engineer", "job_apply_link": "http://x"}]}


def probe(method, url):
    if url.endswith("boom"):
        raise OSError
    return {"http://ok.com/1": 200, "http://head.com/1": 405 if method == "HEAD" else 302}.get(url, 404)


def test_liveness(spark):
    urls = ["http://ok.com/1", "http://ok.com/1", "http://head.com/1", "http://dead.com/1", "http://x.com/boom", "ftp://ok.com", None, "https://a.b.remote.co/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    assert ids(liveness.alive(df, probe)) == [0, 1, 2]


def words(n, word="alpha"):
    return " ".join(f"{word}{i}" for i in range(n))


def test_sections_and_packing():
    text = f"Intro {words(30)}.\n\nAbout:\n\n{words(5)} end.\n\nMINIMUM REQUIREMENTS\n\n- \n\n{words(30, 'b')}.\n\nApplicant privacy policy\n\n{words(40, 'c')}.\n\nLast\n\nWe are an equal opportunity employer {words(30)}.\n\nTiny end."
    found = chunking.sections(text)
    assert [h for h, _ in found] == ["Overview", "MINIMUM REQUIREMENTS", "Last"]
    assert found[1][1][0].startswith("alpha0") and found[2][1] == ["Tiny end."]
    out = chunking.packed([words(60, c) for c in "abcdefghij"])
    assert all(len(p.split()) <= chunking.MOST + chunking.OVERLAP + 1 for p in out) and out[1].startswith("… ")
    assert out[1].split()[1:41] == out[0].split()[-40:]
    assert [n for _, n in chunking.short_pieces(words(750))] == [250, 250, 250]


class Posting(dict):
    pass


def corpus(spark):
    common = words(30, "shared")
    rows = [
        dict(id=1, source_job_id="1", title="Platform Engineer", company="Acme", description=f"You will run kubernetes clusters and kubernetes upgrades. {words(20, 'k')}\n\n{common}"),
        dict(id=2, source_job_id="2", title="ML Engineer", company="Beta", description=f"fraud detection models for payments fraud. {words(20, 'f')}\n\n{common}", required_skills=["python"]),
        dict(id=3, source_job_id="3", title="Risk ML Engineer", company="Gamma", description=f"fraud detection models for risk. {words(20, 'f')}\n\n{common}"),
        dict(id=4, source_job_id="4", title="Fraud Scientist", company="Beta", description=f"fraud science and fraud detection. {words(20, 'f')}"),
        dict(id=5, source_job_id="synthetic-1", title="Fake", company="Gamma", description="fraud fraud fraud"),
    ]
    return listings(spark, rows)


def test_index_and_retrieval(spark):
    jobs, embedder = corpus(spark), V.HashEmbedder()
    first = index.build(jobs, embedder, least=3, now="2026-01-01")
    chunks = first.chunks.cache()
    assert chunks.where("job_id = 5").isEmpty()
    assert not [r for r in chunks.collect() if "shared0" in r.body]
    assert chunks.where("job_id = 2 AND chunk_index = 0").first().body == "ML Engineer at Beta. Skills: python."
    again = index.build(jobs, embedder, first, least=3, now="2026-02-02")
    assert {r.indexed_at.month for r in again.vectors.collect()} == {1}
    changed = jobs.withColumn("description", F.when(F.col("id") == 4, "all new words here").otherwise(F.col("description"))).where("id <> 3")
    third = index.build(changed, embedder, first, least=3, now="2026-02-02")
    assert {(r.job_id, r.indexed_at.month) for r in third.vectors.collect()} == {(1, 1), (2, 2), (4, 2)} or {(r.job_id, r.indexed_at.month) for r in third.vectors.collect()} == {(1, 2), (2, 2), (4, 2)}
    assert third.chunks.where("job_id = 3").isEmpty()

    service = Service(jobs, first, embedder, model=lambda talk: "Run it [1].", now=lambda: NOW)
    assert service.search("kubernetes clusters", "lexical", 3)[0]["job_id"] == 1
    assert service.search("kubernetes clusters", "dense", 3)[0]["job_id"] == 1
    assert service.search("kubernetes", "hybrid", 3)[0]["job_id"] == 1
    assert service.search("the of and", "lexical", 3) == []
    near = service.similar(2)
    assert near["indexed"] and [j["id"] for j in near["jobs"]][0] == 3 and 4 not in [j["id"] for j in near["jobs"]]
    assert service.similar(5) == {"indexed": False, "jobs": []}
    assert service.ask("who runs kubernetes?").status == "answered"
    assert service.jobs(Filters(search="fraud"))["total"] == 1
    assert service.refreshed() == 1
    with pytest.raises(NotFound):
        service.job(99)
    with pytest.raises(ValueError, match="k from"):
        service.search("ab", k=0)


def test_fusion_prefers_agreement(spark):
    a = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, list int, rank int")
    b = spark.createDataFrame([(3, 2, 1), (2, 2, 2)], "id long, list int, rank int")
    assert [r.id for r in retrieval.fused(a, b).orderBy("rank").collect()] == [2, 1, 3]


def test_diversify_matches_greedy(spark):
    rng = random.Random(3)
    for _ in range(6):
        hits = [(i, rng.randrange(4), f"b{rng.randrange(6)}") for i in range(25)]
        kept, count, seen = [], {}, set()
        for i, job, body in hits:
            if len(kept) < 8 and count.get(job, 0) < 2 and body not in seen:
                kept.append(i)
                count[job] = count.get(job, 0) + 1
                seen.add(body)
        df = spark.createDataFrame(hits, "rank int, job_id int, body string")
        assert [r.rank for r in retrieval.diversified(df).collect()] == kept


def test_metrics(spark):
    df = spark.createDataFrame([([5, 5, 7], [7]), ([1, 2], [1]), ([3], [9])], "ranking array<long>, gold array<long>")
    assert metrics.hit_mrr(df).first().asDict() == {"hit_1": 0.333, "hit_5": 0.667, "hit_10": 0.667, "mrr_10": 0.5, "n": 3}
    values = spark.createDataFrame([(float(i),) for i in range(1, 12)], "v double")
    assert metrics.latency_report(values, "v").first().p95 == 11.0  # 0.95 * 10 = 9.5 goes to the even 10
    answers = spark.createDataFrame([(True, "answered", [1], [1], [1]), (True, "abstained", [2], [], [1]), (False, "abstained", [], [], [])], "answerable boolean, status string, context array<int>, cited array<int>, gold array<int>")
    assert metrics.answer_metrics(answers).first().asDict() == {"answered": 50.0, "false_abstain": 50.0, "gold_in_context": 50.0, "gold_cited": 50.0, "cited_when_in_context": 100.0, "correct_abstention": 100.0}


def test_rate_limit_matches_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.randrange(2000))) for i in range(400)] + [(400, 0, dt.datetime(2026, 1, 1, 1)), (401, 0, dt.datetime(2026, 1, 1, 1, 10))]
    state, expected = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, n = state.get(key, (None, 0))
        if start is None or (at - start).total_seconds() >= 600:
            start, n = at, 0
        state[key] = (start, n + 1)
        expected[i] = n + 1 <= 3
    df = spark.createDataFrame(rows, "id long, k int, at timestamp")
    assert {r.id: r.allowed for r in limits.fixed_window(df, "k", "at", "id", 3, 600).collect()} == expected


def test_streaming_limit(spark, tmp_path):
    from tallygrove.streaming import limits as streaming

    kind = "id long, k string, at timestamp"
    source = str(tmp_path / "in")
    rows = [[(1, "a", dt.datetime(2026, 1, 1, 0, 0, 0)), (2, "a", dt.datetime(2026, 1, 1, 0, 0, 5))], [(3, "a", dt.datetime(2026, 1, 1, 0, 0, 9)), (4, "a", dt.datetime(2026, 1, 1, 0, 1, 1))]]
    spark.createDataFrame(rows[0], kind).coalesce(1).write.mode("append").parquet(source)
    out = streaming.fixed_window(spark.readStream.schema(kind).parquet(source), "k", "at", "id", 2, 60)
    run = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        run.processAllAvailable()
        spark.createDataFrame(rows[1], kind).coalesce(1).write.mode("append").parquet(source)
        run.processAllAvailable()
    finally:
        run.stop()
    assert {r.id: r.allowed for r in spark.sql("SELECT * FROM limited").collect()} == {1: True, 2: True, 3: False, 4: True}


def test_flows():
    source = [{"title": "T", "company": "C", "section": "S", "body": "B"}]
    said = iter(["no citation", "It is so 【1†L3】."])
    out = flows.answer("q?", lambda q: source, lambda talk: next(said))
    assert (out.status, out.answer, out.cited, out.attempts) == ("answered", "It is so [1].", [1], 2)
    assert flows.answer("q?", lambda q: [], lambda talk: "").status == "no_results"
    assert flows.answer("q?", lambda q: source, lambda talk: " insufficient. ").status == "abstained"
    assert flows.answer("q?", lambda q: source, lambda talk: "x [9]").status == "ungrounded"
    assert flows.answer("q?", lambda q: 1 / 0, lambda talk: "").status == "error"
    good, bad = (lambda talk: "text"), (lambda talk: 1 / 0)
    assert flows.summarise("p", {"a": good, "b": good, "c": bad}, lambda talk: "all").strategy == "synthesized"
    assert flows.summarise("p", {"a": bad, "b": good}, bad).strategy == "single_draft"
    assert flows.summarise("p", {"a": good, "b": good}, bad).text == "text"
    assert flows.summarise("p", {"a": bad}, good).strategy == "failed"
    assert flows.rescued('```json\n{"a": 1}\n```') == {"a": 1} and flows.rescued('x {"b": 2} y') == {"b": 2}
    with pytest.raises(ValueError, match="JSON"):
        flows.rescued("none")
    time = [0.0]
    cache = flows.Cache(45, lambda: time[0])
    key = cache.key({"b": 1, "a": 2})
    assert key == cache.key({"a": 2, "b": 1})
    cache.put(key, 5)
    assert cache.get(key) == 5
    time[0] = 45.0
    assert cache.get(key) is None


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "b.doc").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("café �", None), "b.doc": (None, "UnsupportedDocument")}
    assert files.document_text("x.pdf", b"", lambda b: ["p1", "p2"]) == "p1\np2"
    with pytest.raises(files.EmptyDocument):
        files.document_text("x.pdf", b"", lambda b: [" "])
    a, b = files.synthetic(spark, 200), files.synthetic(spark, 200).repartition(7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert 0.7 < a.where("salary_min IS NOT NULL").count() / 200 < 0.97


def test_bulk_topk_matches_expressions(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = V.bulk_topk(df.where("id = 3").withColumnRenamed("id", "q"), df, "q", "id", "embedding", 5).orderBy("rank").collect()
    assert [r.id for r in got] == [r.id for r in retrieval.dense_topk(df, rows[3][1], 5).collect()]


def test_evaluation_set(spark):
    from tallygrove.operators import evalset

    long = " ".join(["word"] * 40)
    jobs = spark.createDataFrame([(i, "Data Engineer" if i % 2 else "data engineer", "A" if i < 8 else "B") for i in range(10)], "id long, title string, company string")
    chunks = spark.createDataFrame([(10 * i + c, i, "Profile" if c == 0 else "Role", long if c < 3 else "short") for i in range(10) for c in range(4)], "id long, job_id long, section string, body string")
    picks = evalset.picked(chunks, jobs, 6, 1).cache()
    rows = picks.collect()
    assert len(rows) == 6 and sum(r.company == "A" for r in rows) == 4 and {r.chunk_id % 10 for r in rows} <= {1, 2}
    right = {r.job_id: r.n for r in evalset.gold(picks, jobs).groupBy("job_id").agg(F.count("*").alias("n")).collect()}
    assert right == {r.job_id: 8 if r.company == "A" else 2 for r in rows}

    def model(row):
        if row["job_id"] % 2:
            raise RuntimeError
        return f'"Who asks {row["job_id"]}?"\nand more'

    assert {r.job_id: r.question for r in evalset.questions(picks, model).collect()} == {r.job_id: None if r.job_id % 2 else f"Who asks {r.job_id}?" for r in rows}
    assert evalset.first_line("  ") == ""
    assert [r.id for r in evalset.with_unanswerable(jobs.limit(0).selectExpr("'' AS id", "true AS answerable", "'' AS question"), ["x", "y"]).collect()] == ["u001", "u002"]
