"""The command line on the miniature sources."""

import json
from pathlib import Path

import pytest

from loomgraph import cli

ROOT = Path(__file__).parent.parent / "fixtures" / "mono"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("cli")
    config = out / "config.json"
    config.write_text(json.dumps({"id": "mono", "root": f"file://{ROOT}", "apps_glob": "apps/*"}))
    assert cli.main(["build", str(config), str(out / "graph")]) == 0
    return str(out / "graph")


def test_lists(graph, capsys):
    assert cli.main(["publishers", graph, "orders.placed"]) == 0
    assert json.loads(capsys.readouterr().out)["sites"][0]["owner"] == "service:api"
    assert cli.main(["consumers", graph, "mail", "--table"]) == 0
    assert "service:worker" in capsys.readouterr().out
    assert cli.main(["producers", graph, "nope"]) == 4
    assert json.loads(capsys.readouterr().out) == {"found": False}


def test_walks_and_drawing(graph, capsys):
    assert cli.main(["path", graph, "service:api", "service:worker"]) == 0
    assert json.loads(capsys.readouterr().out)["nodes"][0] == "service:api"
    assert cli.main(["path", graph, "service:worker", "nope"]) == 4
    assert cli.main(["module-imports", graph, "AppModule"]) == 0
    assert "DbModule" in capsys.readouterr().out
    assert cli.main(["mermaid", graph, "--slice", "service:api"]) == 0
    assert "service_api[" in capsys.readouterr().out
    assert cli.main(["mermaid", graph, "--slice", "domain:nope"]) == 1


def test_words(graph, capsys):
    assert cli.main(["ask", graph, "who consumes the queue 'mail'"]) == 0
    assert "service:worker" in capsys.readouterr().out
    assert cli.main(["ask", graph, "hello"]) == 4
    assert cli.main(["stats", graph]) == 0
    assert cli.main(["deps", graph, "api"]) == 0
    assert cli.main(["explain", graph, "queue:mail"]) == 0
    assert cli.main(["publishers", "/no/such/graph", "x"]) == 1
