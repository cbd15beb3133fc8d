"""The repository as files: patches with undo, paths that leave it, locks of an index, capabilities and noise keys."""

import os

import pytest

from tesserae.operators import tasks
from tesserae.sources import files, generations


def test_patches_and_undo(tmp_path):
    root = str(tmp_path)
    log = [files.patch(root, "a/b.txt", "one\ntwo\nthree\n")]
    log.append(files.patch(root, "a/b.txt", "2\n", 2, 2))
    assert (tmp_path / "a/b.txt").read_text() == "one\n2\nthree\n"
    with pytest.raises(ValueError, match="no such lines"):
        files.patch(root, "a/b.txt", "x", 9)
    for path in ("../x", "/etc/x", "~/x", "a/../../x"):
        with pytest.raises(ValueError, match="leaves"):
            files.patch(root, path, "x")
    files.undo(root, log[1:])
    assert (tmp_path / "a/b.txt").read_text() == "one\ntwo\nthree\n"
    files.undo(root, log[:1])
    assert not (tmp_path / "a/b.txt").exists()


def test_lock(tmp_path):
    folder = str(tmp_path / "index")
    with generations.locked(folder):
        with pytest.raises(BlockingIOError), generations.locked(folder):
            pass
    (tmp_path / "index/lock").write_text("999999999")  # nobody has that number: the owner died
    with generations.locked(folder):
        assert (tmp_path / "index/lock").read_text() == str(os.getpid())
    assert not (tmp_path / "index/lock").exists()


def test_tree_stamp(tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    first = files.tree_stamp(str(tmp_path))
    assert files.tree_stamp(str(tmp_path)) == first
    (tmp_path / "b.py").write_text("")
    assert files.tree_stamp(str(tmp_path)) != first


def test_profile_key():
    assert tasks.profile_key("a", "b", "c", "d").startswith("np_") and tasks.profile_key("a", "b", "c", "d") != tasks.profile_key("a", "b", "c", "e")
