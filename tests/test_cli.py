from __future__ import annotations

import json

import pytest

from strandline import cli


def test_tool_protocol():
    calls = []
    search = lambda q, top: calls.append((q, top)) or "found"
    ask = lambda method, number=1, **params: cli.tool_answer({"jsonrpc": "2.0", "id": number, "method": method, "params": params}, search)
    assert ask("initialize", protocolVersion="x")["result"]["protocolVersion"] == "x"
    assert ask("tools/list")["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    assert ask("tools/call", name="search", arguments={"query": " a b ", "top": 3})["result"]["content"] == [{"type": "text", "text": "found"}]
    assert calls == [("a b", 3)]
    assert ask("tools/call", name="search", arguments={"query": " "})["result"]["isError"]
    assert ask("tools/call", name="other", arguments={"query": "a"})["result"]["isError"]
    assert ask("none")["error"]["code"] == -32601
    assert ask("notifications/initialized", number=None) is None


def test_index_and_search(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("tomato sauce\n")
    (tmp_path / "src" / "b.md").write_text("nearest neighbour\n")
    out = f"file://{tmp_path}/index"
    assert cli.main(["index", "--files", str(tmp_path / "src"), "--out", out, "--shards", "2"]) == 0
    assert cli.main(["search", "tomato", "--index", out, "--top", "1"]) == 0
    said = capsys.readouterr().out
    assert "Indexed 2 passages." in said
    assert "[und]  file:a.md:1-1" in said
    assert cli.main(["stop", "--index", out]) == 1
    assert cli.main(["index", "--out", out]) == 2
    assert cli.main(["index", "--files", str(tmp_path / "none"), "--out", out]) == 2
    with pytest.raises(SystemExit):
        cli.main(["search", "x", "--index", out, "--source", "web"])


def test_resident_service(spark, tmp_path):
    import threading

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("tomato sauce\n")
    index = f"{tmp_path}/index"
    args = cli.parser().parse_args(["serve", "--files", str(tmp_path / "src"), "--index", index])
    service = cli.Service(args)
    server = service.listen(index)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    assert [r["location"] for r in cli.ask(index, {"query": "tomato", "top": 99})["results"]] == ["a.md:1-1"]
    assert cli.ask(index, {"query": ""})["error"]
    about = json.loads(cli.sidecar(index).read_text())
    cli.sidecar(index).write_text(json.dumps(about | {"token": "wrong"}))
    assert cli.ask(index, {"query": "tomato"})["error"] == "not allowed"
    cli.sidecar(index).write_text(json.dumps(about))
    assert cli.ask(index, {"command": "stop"})["stopped"]
    thread.join(10)
    service.close(index)
    assert cli.ask(index, {"query": "tomato"}) is None


def test_installers(tmp_path):
    config = tmp_path / ".github" / "mcp.json"
    config.parent.mkdir()
    config.write_text('{"servers": {"mine": {}}, "other": 1}')
    assert cli.main(["install-mcp", "--repository", str(tmp_path)]) == 0
    kept = json.loads(config.read_text())
    assert set(kept["servers"]) == {"mine", "strandline"} and kept["other"] == 1
    assert cli.main(["install-skill", "--repository", str(tmp_path)]) == 0
    assert (tmp_path / ".github" / "skills" / "strandline" / "SKILL.md").exists()


def test_languages_of_an_index(spark, tmp_path, capsys):
    rows = [("the cat and the dog are here with the others", "en"), ("this is the house of the man", "en"), ("le chat et le chien sont ici avec les autres", "fr"), ("voici la maison de monsieur", "fr")]
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_path}/labelled")
    assert cli.main(["train-language", "--table", f"{tmp_path}/labelled", "--out", f"{tmp_path}/model"]) == 0
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("the tomato is in the house\n")
    (tmp_path / "src" / "b.md").write_text("la tomato est dans la maison\n")
    out = f"{tmp_path}/index"
    assert cli.main(["index", "--files", str(tmp_path / "src"), "--out", out, "--shards", "2", "--language-model", f"{tmp_path}/model"]) == 0
    capsys.readouterr()
    for lang, place in (("en", "a.md"), ("fr", "b.md")):
        assert cli.main(["search", "tomato", "--index", out, "--lang", lang]) == 0
        said = capsys.readouterr().out
        assert f"[{lang}]  file:{place}" in said and said.count("file:") == 1


def test_warm_and_cold_searches_print_the_same(spark, tmp_path, capsys):
    import threading

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("tomato sauce " * 30 + "\n")
    index = f"{tmp_path}/index"
    service = cli.Service(cli.parser().parse_args(["serve", "--files", str(tmp_path / "src"), "--index", index]))
    assert cli.main(["search", "tomato", "--index", index]) == 0
    cold = capsys.readouterr().out
    server = service.listen(index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert cli.main(["search", "tomato", "--index", index]) == 0
    assert capsys.readouterr().out == cold and "…" in cold
    server.shutdown()
    service.close(index)


def test_service_watches_its_folder(spark, tmp_path):
    import time

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("alpha words")
    index = str(tmp_path / "index")
    service = cli.Service(cli.parser().parse_args(["serve", "--files", str(tmp_path / "src"), "--index", index, "--watch", "200", "--debounce", "100"]))
    try:
        (tmp_path / "src" / "b.md").write_text("beta words")
        (tmp_path / "src" / "a.md").unlink()
        until = time.time() + 90
        shown = lambda: sorted(r["location"] for r in service.live.index().records.collect())
        while shown() != ["b.md:1-1"] and time.time() < until:
            time.sleep(0.5)
        assert shown() == ["b.md:1-1"]
    finally:
        service.close(index)
