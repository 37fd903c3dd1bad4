import datetime as dt
import unicodedata

import pytest

from voxloom.operators.diff import listing_diff, only_per_folder, plain_path, plain_paths, presence

T = dt.datetime(2026, 2, 1, 12, 0, 0)
LOCAL = "rel_path string, is_dir boolean, local_size long, content_hash string, modified_at timestamp, listed_at timestamp"
REMOTE = "rel_path string, is_dir boolean, remote_size long, content_hash string, remote_modified string, listed_at timestamp"


def test_spellings(spark):
    name = "p/a b/résumé 40%.md"
    local = [
        (name, False, 5, "ABCD", T.replace(microsecond=900000), T), ("only", False, None, None, None, T), ("dir", True, None, None, T, T),
        ("old", False, 1, "x", T, T), ("old", False, 2, "y", T, T + dt.timedelta(1)), ("null", False, 1, None, None, T), (None, False, 1, "a", T, T), ("Case", False, 1, "a", T, T),
    ]
    remote = [
        ("/p//a%20b/" + "re%CC%81sume%CC%81%2040%25.md", False, 5, 'W/"abcd"', "Sun, 01 Feb 2026 14:00:00 +0200", T),
        (".\\old", False, 2, '"Y"', "2026-02-01T12:00:01Z", T), ("null", False, None, "z", "-", T), ("case", False, 1, "a", "1769947200", T), ("dir/", True, None, None, "", T),
    ]
    diff = listing_diff(spark.createDataFrame(local, LOCAL).selectExpr("*", "1 as diff"), spark.createDataFrame(remote, REMOTE))
    assert sorted(map(tuple, diff.collect())) == sorted(
        [("only", "local_only"), ("Case", "local_only"), ("case", "remote_only"), ("old", "remote_newer"), ("null", "size"), ("null", "hash")]
    )
    assert sorted(map(tuple, only_per_folder(diff).collect())) == [("", 1)]
    assert listing_diff(spark.createDataFrame([], LOCAL), spark.createDataFrame([], REMOTE)).count() == 0


def test_plain_path():
    assert plain_path("./a%2Fb\\c//d/", True) == "a/b/c/d"
    assert plain_path("40% x", True) == "40% x"
    assert plain_path("%ff", True) == "%ff"
    assert plain_path("a%20b", False) == "a%20b"
    assert plain_path(None, True) is None
    assert plain_path(unicodedata.normalize("NFD", "é"), False) == "é"


def test_plain_paths_as_columns(spark):
    texts = ["./a%2Fb\\c//d/", "40% x", "%ff", "a%20b", "a+b%2B", None, "", "/", "re\u0301sume\u0301 %CC", "e%CC%81", "%EF%BF%BD", "\ufffd%41", "%zz%41", "день/%D0%B4", "a%E4%BD%A0", "%ED%A0%80"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    for decode in (True, False):
        assert [r[0] for r in df.select(plain_paths("p", decode)).collect()] == [plain_path(t, decode) for t in texts]


@pytest.mark.parametrize("blocks, files", [(1, 70_000), (5, 300)])
def test_presence_by_bitmaps(spark, blocks, files):
    rows = spark.range(files).selectExpr("concat('p/', id) as rel_path", "id % 7 = 3 as is_dir", "timestamp_seconds(id) as listed_at", "id")
    presence_of = {(r.path): r.side for r in presence(rows.where("id % 3 <> 0"), rows.where("id % 5 <> 0"), blocks).collect()}
    want = {f"p/{i}": "both" if i % 3 and i % 5 else "local_only" if i % 3 else "remote_only" for i in range(files) if (i % 3 or i % 5) and i % 7 != 3}
    assert presence_of == want
