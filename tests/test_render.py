import pytest

from trailmine.plans.render import Sink, check_format, exemplar, graph, mermaid_label, parse_range


def test_sink_counts_what_is_left_out():
    out = []
    sink = Sink(out.append, limit=2)
    sink.head("head")
    assert [sink.row(x) for x in "abc"] == [True, True, False]
    sink.close(total=7)
    assert out == ["head\n", "a\n", "b\n", "... +5 more\n"]


def test_sink_keeps_to_its_bytes():
    out = []
    sink = Sink(out.append, max_bytes=5)
    assert sink.row("abc") and not sink.row("def") and not sink.row("x")
    sink.close()
    assert out[-1] == "... +2 more\n"


def test_formats():
    check_format("text", max_bytes=9)
    with pytest.raises(ValueError):
        check_format("yaml")
    with pytest.raises(ValueError):
        check_format("json", max_bytes=9)


def test_ranges():
    assert parse_range("3") == (3, 3)
    assert parse_range("2-5") == (2, 5)
    for bad in ("1", "5-2", "x", "2-", "-3"):
        with pytest.raises(ValueError):
            parse_range(bad)


def test_labels_and_graphs():
    assert mermaid_label('a["{}"]') == "a#91;#quot;#123;#125;#quot;#93;"
    edges = [{"src": "a", "dst": 'b"', "n": 2}]
    assert graph(edges) == 'graph LR\n  n0["a"]\n  n1["b#quot;"]\n  n0 -->|2| n1\n'
    assert graph(edges, "dot") == 'digraph follows {\n  "a" -> "b\\"" [label=2];\n}\n'
    assert graph([]) == "graph LR\n"


def test_exemplars():
    assert exemplar("p/0123456789@", 4) == "01234567@4"
    assert exemplar("p/abc@x", 4) == "abc@4"
