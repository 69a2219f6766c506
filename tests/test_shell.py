import pytest

from trailmine.functions.shell import split


@pytest.mark.parametrize(
    ("line", "commands"),
    [
        ("", []), ("   ", []), ("# only a note", []), (None, []), ("echo a; pwd", []), ("cd /w && go test ./... | tail -3", ["go_test"]), ("make -j4 all", ["make"]), ("make all", ["make_all"]),
        ("A=1 B=2", []), ("A=$(ls | wc -l); kubectl get pods", ["kubectl_get"]), ("$TOOL run", ["complex"]), ('"git" log', ["complex"]), ("/usr/bin/git log", ["git_log"]), ("true | jq .", ["jq"]),
        ("if rg -q x; then cargo build; else npm test; fi", ["rg", "cargo_build"]), ("while read l; do wc $l; done < f", ["read", "wc"]), ("for f in a b; do gofmt $f; done", ["gofmt"]),
        ("case $x in a) ls;; *) rm x;; esac; jq .", ["jq"]), ("f() { ls; }; f", ["f"]), ("(cd a; uv run x) && { ls; wc; }", ["uv_run", "ls", "wc"]), ("[[ -f x ]] && cat x", ["cat"]), ("export A=1; pytest -q", ["pytest"]),
        ("cat <<EOF | wc\na ( b\nEOF\nls", ["cat", "ls"]), ("python3 - <<'E'\nx=')'\nE", ["python3"]), ("diff <(ls a) <(ls b)", ["diff"]), ("git commit -m 'a; b' & ls", ["git_commit", "ls"]), ("time ! rg x", ["rg"]),
    ],
)
def test_split(line, commands):
    found, crude = split(line)
    assert [c for c, _ in found] == commands
    assert not crude


@pytest.mark.parametrize(("line", "commands"), [("ls 'open", ["ls"]), ("ls )", ["ls"]), ("if x; then", ["if"]), ("echo 'open", [])])
def test_unreadable_lines_give_their_first_word(line, commands):
    found, crude = split(line)
    assert crude
    assert [c for c, _ in found] == commands


def test_long_lines():
    found, crude = split("ls; " * 3000)
    assert len(found) == 3000 and not crude
