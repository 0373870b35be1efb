"""Changes over all tables of a catalog."""

from silverframe.operators import catalog_changes as changes


def made(spark):
    table = spark.createDataFrame
    return changes.Catalog(
        table([(i, f"n{i}") for i in (1, 2, 3)], "id long, name string"),
        table([(1, 5), (2, 6), (9, 7)], "id long, updated_at long"),
        table([(1, 10, "a"), (2, 20, "b")], "album_id long, updated_at long, name string"),
        table([(1, 0, 2), (1, 1, 1), (1, 2, 9), (2, 0, 3)], "album_id long, pos long, entry_id long"),
        table([(3,), (9,)], "id long"),
    )


def seen(t):
    return sorted(tuple(r) for r in t.collect())


def test_changes(spark):
    c = made(spark)
    ids = spark.createDataFrame([(2,), (2,), (None,), (77,)], "id long")
    a = changes.archive_entries(c, ids, 99)
    assert seen(a.archive) == [(2,), (3,), (9,), (77,)]
    assert seen(a.members) == [(1, 0, 1), (1, 1, 9), (2, 0, 3)]
    assert seen(a.albums) == [(1, 99, "a"), (2, 99, "b")]
    assert seen(a.entries) == seen(c.entries) and seen(a.metadata) == seen(c.metadata)
    r = changes.restore_entries(a, ids)
    assert seen(r.archive) == [(3,), (9,)] and seen(r.members) == seen(a.members)
    d = changes.delete_entries(c, ids)
    assert [seen(t) for t in (d.entries, d.metadata, d.archive)] == [[(1, "n1"), (3, "n3")], [(1, 5)], [(3,)]]
    assert seen(d.members) == [(1, 0, 1), (2, 0, 3)] and seen(d.albums) == seen(c.albums)
    t = changes.take_from_albums(c, ids, 99, album=2)
    assert seen(t.members) == seen(c.members) and seen(t.albums) == [(1, 10, "a"), (2, 99, "b")]


def test_no_ids_change_nothing(spark):
    c = made(spark)
    none = spark.createDataFrame([(None,)], "id long")
    assert seen(changes.archive_entries(c, none, 99).albums) == seen(c.albums)
    assert seen(changes.rows(changes.restore_entries(c, none))) == seen(changes.rows(c))
