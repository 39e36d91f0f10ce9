"""The guard over folders: git's view of them, forbidden kinds of file, and what texts hold."""

import subprocess

from pennybrook.operators import guard


def test_git_view_and_scan(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "deep").mkdir(parents=True)
    lines = "2026-01-02 paid 12.50\n" * 3
    for name, text in (("a.md", "id 12345678901234567X."), ("deep/b.csv", "x,y"), ("deep/c.py", lines), ("new.txt", "z"), ("ignored.md", "id 12345678901234567X."), ("ok.json", "plain"), (".gitignore", "ignored.md\n"), ("code.ts", lines)):
        (root / name).write_text(text)
    (root / "bin.md").write_bytes(b"\0" + lines.encode())
    assert guard.git_listing(spark, str(root)) is None
    everything = {r["path"] for r in guard.guarded_files(spark, str(root)).select("path").collect()}
    assert everything >= {"a.md", "deep/b.csv", "ignored.md"}
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.md", "deep/b.csv", "ok.json", "bin.md", "code.ts")
    git("-c", "user.name=t", "-c", "user.email=t@x.test", "commit", "-qm", "x")
    git("add", "deep/c.py")  # staged and tracked: listed once
    listed = [r["path"] for r in guard.git_listing(spark, str(root)).collect()]
    assert sorted(listed) == ["a.md", "bin.md", "code.ts", "deep/b.csv", "deep/c.py", "ok.json"]
    files = guard.guarded_files(spark, str(root))
    found = sorted((r["path"], r["rule"]) for r in guard.scan_files(files).collect())
    assert found == [("a.md", "card-number"), ("a.md", "resident-id"), ("deep/b.csv", "forbidden-extension"), ("deep/c.py", "statement-like")]
    assert sorted(r["path"] for r in guard.scan_files(files, allowed=r"^deep/", skipped=r"^a\.md$").collect()) == []
