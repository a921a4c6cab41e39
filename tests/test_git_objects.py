"""Files of commits against what git itself says."""

import os
import random
import shutil
import subprocess

import pytest

from tessera.sources import git_objects

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="no git here to make a repository")


def git(at, *args):
    env = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    return subprocess.run(["git", *args], cwd=at, env=env, check=True, capture_output=True).stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Two packed commits with long delta chains, and one of loose objects on top."""
    at = tmp_path_factory.mktemp("repository")
    r = random.Random(1)
    git(at, "init", "-q", "-b", "main")
    lines = [f"line {r.random()}\n" for _ in range(3000)]
    (at / "src/deep/er").mkdir(parents=True)
    for k in range(2):
        for i in range(12):
            lines[r.randrange(3000)] = f"changed {i}\n"
            (at / f"src/deep/er/f{i}.txt").write_text("".join(lines))
            (at / f"src/g{i}.bin").write_bytes(r.randbytes(i * 1000))
        (at / "empty").write_text("")
        (at / "é 中.md").write_text(f"text {k}")
        git(at, "add", "-A")
        git(at, "commit", "-q", "-m", f"c{k}")
        git(at, "tag", f"v{k}")
    git(at, "tag", "-a", "signed", "-m", "x", "v0")
    git(at, "repack", "-q", "-a", "-d", "-f", "--depth=40", "--window=40")
    git(at, "pack-refs", "--all")
    git(at, "checkout", "-q", "-b", "work")
    (at / "src/deep/new.txt").write_text("new")
    (at / "empty").unlink()
    git(at, "add", "-A")
    git(at, "commit", "-q", "-m", "loose")
    return at


@pytest.mark.parametrize("ref", ["HEAD", "main", "v0", "signed", "work", "refs/tags/v1"])
def test_files_of_a_commit(spark, repository, ref):
    commit, files = git_objects.commit_files(spark, str(repository), ref)
    assert commit == git(repository, "rev-parse", f"{ref}^{{commit}}").decode().strip()
    want = {}
    for line in git(repository, "ls-tree", "-r", "-z", commit).split(b"\0")[:-1]:
        meta, path = line.split(b"\t", 1)
        mode, _, name = meta.decode().split()
        want[path.decode()] = (mode, name)
    got = files.collect()
    assert {r.path: (r.mode, r.hash) for r in got} == want
    assert all(bytes(r.bytes) == git(repository, "cat-file", "blob", r.hash) for r in got)


def test_bare_hashes_and_missing(spark, repository, tmp_path):
    git(tmp_path, "clone", "-q", "--bare", str(repository), "bare.git")
    full = git(repository, "rev-parse", "v1").decode().strip()
    commit, files = git_objects.commit_files(spark, str(tmp_path / "bare.git"), full)
    assert commit == full and files.count() == 26
    with pytest.raises(LookupError, match="ref"):
        git_objects.commit_id(str(repository), "nowhere")
    with pytest.raises(FileNotFoundError):
        git_objects.git_folder(str(tmp_path))


def test_patches():
    base = bytes(range(256)) * 300
    copy = bytes([0x80 | 0x01 | 0x02 | 0x10, 5, 1, 7])  # 7 bytes from 261
    assert git_objects.patched(base, b"\x80\x01\x07" + copy + b"\x03abc") == base[261:268] + b"abc"
    assert git_objects.patched(base, b"\x01\x01" + bytes([0x80])) == base[:65536]
