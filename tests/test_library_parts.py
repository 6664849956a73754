"""Parts of a library as a data source list its entries once and look closely at their own."""

from pyspark.sql.datasource import EqualTo

from lodestrata.sources import libraries, library_source


def test_each_entry_is_classified_by_its_own_part_alone(monkeypatch, tmp_path):
    items = [(f"{'m' if i % 3 else 'w'}_{i:03}.sr{'m' if i % 3 else 'w'}", bytes([i % 256]) * (10 * i + 1)) for i in range(200)]
    (tmp_path / "a.pbl").write_bytes(libraries.build(items))
    (tmp_path / "b.pbl").write_bytes(b"no library")
    reader = library_source.LibraryReader({"path": f"file://{tmp_path}", "splitBytes": "20000"})
    assert list(reader.pushFilters([EqualTo(("type_name",), "menu")])) == []
    seen, type_of = [], libraries.type_of
    monkeypatch.setattr(libraries, "type_of", lambda name, comment="": seen.append(name) or type_of(name, comment))
    bundles = reader.partitions()
    rows = [r for b in bundles for batch in reader.read(b) for r in batch.to_pylist()]
    assert len(bundles) > 5 and sorted(seen) == sorted(n for n, _ in items)
    assert sorted((r["name"], r["data"]) for r in rows) == sorted((n, d) for n, d in items if n[0] == "m")
    whole = {e["name"]: e for e in libraries.entries((tmp_path / "a.pbl").read_bytes())}
    assert all({k: v for k, v in r.items() if k in whole[r["name"]] and k not in ("modified",)} == {k: v for k, v in whole[r["name"]].items() if k != "modified"} for r in rows)


def test_many_parts_are_read_by_fewer_tasks_and_listed_once_there(monkeypatch, tmp_path):
    monkeypatch.setattr(library_source, "TASKS", 4)
    items = [(f"w_{i:03}.srw", bytes([i]) * 900) for i in range(200)]
    for n in "ab":
        (tmp_path / f"{n}.pbl").write_bytes(libraries.build(items))
    reader = library_source.LibraryReader({"path": f"file://{tmp_path}", "splitBytes": "20000"})
    bundles = reader.partitions()
    seen, entries = [], library_source.entries
    monkeypatch.setattr(library_source, "entries", lambda *a, **b: seen.append(1) or entries(*a, **b))
    rows = [r for b in bundles for batch in reader.read(b) for r in batch.to_pylist()]
    assert 4 <= len(bundles) <= 6 and sum(len(b.parts) for b in bundles) > 20 and len(seen) <= 7
    assert sorted((r["path"][-5], r["name"], r["data"]) for r in rows) == sorted((n, *e) for n in "ab" for e in items)
