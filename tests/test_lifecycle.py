import os

import pytest

from symgraph.operators.search import exact_search
from symgraph.sources import walk
from symgraph.streaming.lifecycle import Options, Store


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_py", ".py").replace("_go", ".go")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, ns=(1, path.stat().st_size * 1000 + hash(text) % 1000))


def test_refresh_replaces_prunes_and_keeps_options(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, a_py="def one():\n    pass\n", src__b_go="package b\n\nfunc Two() {\n\tThree()\n}\n", gen__c_py="def four():\n    pass\n")
    (root / ".git").mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(LookupError):
        store.index()
    stats = store.refresh(str(root), Options(exclude=("gen/**",)))
    assert (stats["files_indexed"], stats["files_excluded"], stats["stale_removed"], stats["symbols_found"]) == (2, 1, 0, 2)
    idx = store.index()
    names = lambda idx: sorted(r.name for r in idx.symbols.collect())
    assert names(idx) == ["Two", "one"]
    # Nothing changed: nothing is read. The options are those of the first run.
    stats = store.refresh(str(root))
    assert (stats["files_indexed"], stats["files_skipped"], stats["files_excluded"]) == (0, 2, 1) and names(store.index()) == ["Two", "one"]
    assert store.refresh(str(root), force=True)["files_indexed"] == 2 and names(store.index()) == ["Two", "one"]
    # One file changes, one goes, one comes; a damaged one has no symbols.
    write(root, a_py="def uno():\n    pass\n\n\ndef due():\n    pass\n", d_py="def five(:\n")
    (root / "src" / "b.go").unlink()
    stats = store.refresh(str(root))
    assert (stats["files_indexed"], stats["stale_removed"], stats["parse_errors"]) == (2, 1, 1)
    idx = store.fresh(str(root / "a.py"))
    assert names(idx) == ["due", "uno"] and idx.refs.count() == 0 and exact_search(idx, ["uno"]).count() == 1
    assert [(r.root, r.n_files, r.n_symbols) for r in store.repositories().collect()] == [(str(root), 2, 2)]
    assert store.meta("note") is None and store.set_meta("note", "x") and store.meta("note") == "x" and store.options().exclude == ("gen/**",)
    assert names(store.index()) == ["due", "uno"] and store.vacuum() > 0 and names(store.index()) == ["due", "uno"]


def test_second_repository_and_failed_refresh(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    for name in ("x", "y"):
        write(tmp_path / name, a_py=f"def {name}():\n    pass\n")
        store.refresh(str(tmp_path / name))
    assert sorted(r.name for r in store.index().symbols.collect()) == ["x", "y"]
    monkeypatch.setattr(Store, "refresh", lambda *a: 1 / 0)
    assert store.fresh(str(tmp_path / "x")).files.count() == 2
    with pytest.raises(ZeroDivisionError):
        Store(spark, f"file://{tmp_path}/none").fresh(str(tmp_path / "x"))


def test_guard(tmp_path):
    root = tmp_path / "r"
    (root / ".git").mkdir(parents=True)
    (root / "a.py").write_text("")
    (root / "out").symlink_to(tmp_path)
    assert walk.guarded(str(root), "a.py").endswith("/r/a.py") and walk.find_root(str(root / "a.py")) == str(root)
    for bad in ("../x", "out/x", ".git/config"):
        with pytest.raises(PermissionError):
            walk.guarded(str(root), bad)
