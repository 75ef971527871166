import json
import os

import pytest

from corpusloom import registry
from corpusloom.sources import storage

from .conftest import rows

DATA = "/root/testdata/sf0.001"


def test_content_files(spark, tmp_path):
    lines = [json.dumps({"url": "https://e.com/a", "title": None, "text": "x", "html": "<p>", "crawled_at": "2024-01-01T00:00:00"}), "", "{broken", json.dumps({"url": "https://e.com/b", "title": "B", "extra": 1})]
    for session in (9, 10):
        (tmp_path / f"content_{session}.jsonl").write_text("\n".join(lines) + "\n")
    content = storage.read_all_content(spark, str(tmp_path))
    assert content.count() == 4
    last = storage.latest_session(content)
    assert {r.session_id for r in last.collect()} == {10}
    out = os.path.join(tmp_path, "csv")
    storage.export_csv(last, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert text.startswith("url,title,description,crawled_at")
    storage.export_json(last, os.path.join(tmp_path, "json"))
    assert storage.preview(last).where("url = 'https://e.com/a'").first().html_length == 3
    storage.write_content(last, os.path.join(tmp_path, "store"))
    assert os.path.isdir(os.path.join(tmp_path, "store", "session_id=10"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_every_query_runs(spark):
    for name, query in registry.QUERIES.items():
        assert query(spark, DATA).count() >= 0, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stored_change_log_is_reproduced(spark):
    """The stored changes are the detected ones.  Their line counts come from a
    comparison of line sets, so only those of first versions must be equal."""
    stored = storage.deduplicated(storage.load(spark, DATA, "content_changes"))
    found = registry.changes_diff(spark, DATA)
    for columns, which in ((["url", "old_version_id", "new_version_id", "change_type"], "true"), (["new_version_id", "added_lines", "removed_lines", "change_percent"], "change_type = 'added'")):
        assert rows(found.where(which), *columns) == rows(stored.where(which), *columns)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "search_bm25" in entry.queries()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_flagship_query_runs(spark):
    """The query the driver smokes, on the smallest tables."""
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns[:2] == ["doc_id", "url"] and 0 < found.count() <= 20
