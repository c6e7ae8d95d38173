"""Search over a catalog of files against a plain cascade, and the listing of real files."""

from pathlib import Path, PurePosixPath

import pytest

from netpanel.sources import catalog as K

PATHS = [
    "data/raw/crsp/1999.csv", "data/raw/crsp/2000.csv", "data/samples/1999/var.pkl", "data/samples/2000/var.pkl", "data/samples/2000/var_cv.pkl",
    "data/samples/2000/.hidden", "data/a.tar.gz", "data/a.tar", "data/a", "Data/Größe/ß.csv", "data/samples/2000/x.", "data/q%5/under_score.csv", "data/folder/",
]
QUERIES = ["var.pkl", "var", "1999", "cv", "raw/crsp", "a.tar", "a", "a.tar.gz", "s", "ß", "Größe", "none at all", ".hidden", "x.", "%5", "_", "r_s", "folder", "2000/var.pkl", "zzz/2000.csv"]


def cascade(query, within):
    name, stem = PurePosixPath(query).name, PurePosixPath(query).stem
    for rank, test in enumerate((lambda p: PurePosixPath(p).name == name, lambda p: PurePosixPath(p).stem == stem, lambda p: query in p), 1):
        hits = [p for p in PATHS if test(p)]
        if hits:
            return {(query, within, p, rank) for p in hits if within is None or within in [q.name for q in PurePosixPath(p).parents]}
    return set()


@pytest.mark.parametrize("within", [None, "2000", "data", "nowhere"])
def test_search_equals_a_plain_cascade(spark, within):
    catalog = spark.createDataFrame([(p,) for p in [*PATHS, PATHS[0], None]], "path string")
    wanted = spark.createDataFrame([(q, within) for q in [*QUERIES, QUERIES[0], "", None]], "query string, within string")
    got = [tuple(r) for r in K.search_all(catalog, wanted).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set().union(*(cascade(q, within) for q in QUERIES))


def test_search_in_an_empty_catalog_and_for_nothing(spark):
    catalog, wanted = spark.createDataFrame([(p,) for p in PATHS], "path string"), spark.createDataFrame([("var", None)], "query string, within string")
    assert K.search_all(catalog.limit(0), wanted).count() == 0 and K.search_all(catalog, wanted.limit(0)).count() == 0


def test_files_are_found_below_a_folder(spark, tmp_path):
    for p in ("a.csv", "b/c.csv", "b/d/e.txt", "b/d/empty.csv"):
        f = Path(tmp_path, p)
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("" if "empty" in p else "x" * len(p))
    found = {r.path.split(f"{tmp_path}/")[1]: r.bytes for r in K.files(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.csv": 5, "b/c.csv": 7, "b/d/e.txt": 9}  # empty files are not listed
    csv = K.files(spark, f"file://{tmp_path}", "*.csv")
    assert csv.count() == 2 and csv.schema.names == ["path", "bytes", "modified"]


def test_no_side_of_the_search_is_broadcast(spark):
    catalog, wanted = spark.createDataFrame([(p,) for p in PATHS], "path string"), spark.createDataFrame([(q, None) for q in QUERIES], "query string, within string")
    assert "Broadcast" not in K.search_all(catalog, wanted)._jdf.queryExecution().executedPlan().toString()
