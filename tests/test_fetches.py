from inkweave.catalog import state
from inkweave.sources.readers import captured_pages, latest_fetch

LOG = "page_id long, url string, ts long, status int, content_type string, retry_after string"


def test_pages_of_one_address_keep_their_own_attempts(spark, tmp_path):
    rows = [(k, "https://h/same" if k in (3, 8, 12) else f"https://h/{k}", "<p>x</p>") for k in range(1, 20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for k, _, _ in rows:
        n = (k + k % 3 * 5) % 8
        want[k] = "limited" if n < 2 else "failed" if n == 2 else "empty" if k % 9 == 7 else "not_html" if n == 4 else "ok"
    for query in (state.fetch_outcome, state.fetch_outcome_stream):
        assert {r.page_id: r.outcome for r in query(spark, str(tmp_path)).collect()} == want


def test_attempts_of_one_time_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "u", 5, s, "text/html", None) for s in (200, 404, 429, 200)]
    for turn in (rows, rows[::-1], rows[2:] + rows[:2]):
        log = spark.createDataFrame(turn, LOG).coalesce(1)
        assert [r.status for r in latest_fetch(log).collect()] == [429]
        pages = spark.createDataFrame([(7, "u", "x")], "page_id long, url string, html string")
        assert captured_pages(pages, log).first().outcome == "limited"
