"""Command line: index, search, serve, mcp, stop."""

from __future__ import annotations

import argparse
import json
import os
import secrets
import socket
import socketserver
import sys
import threading
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import location_path
from .operators.language import NaiveBayes
from .operators.vectors import HashingEmbedder, StaticEmbedder
from .plans.service import TOP, SearchService
from .plans.snapshot import Store, build, shards_for, to_records
from .schemas import CHANGE, PASSAGE
from .shipping import ship
from .sources.files import git_ignored, scan_directory, scan_paths
from .sources.git import scan_commits
from .streaming.live import DEBOUNCE_MS, LiveIndex, change_feed
from .streaming.watch import FolderWatcher

CONNECT_S, READ_S = 1, 60


def session() -> SparkSession:
    spark = SparkSession.builder.appName("strandline").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    return spark


def embedder_of(args):
    """A static embedder if both model files are named (and exist), else the hashing one."""
    if bool(args.vocabulary) != bool(args.matrix):
        raise ValueError("--vocabulary and --matrix belong together")
    return StaticEmbedder(args.vocabulary, args.matrix) if args.vocabulary else HashingEmbedder()


def language_of(args, spark: SparkSession):
    """The stored language model that is named, or None: then every passage is ``und``."""
    return NaiveBayes.load(spark, args.language_model) if args.language_model else None


def train_language_command(args) -> int:
    """Learn languages from a Parquet table of labelled texts and store the model."""
    spark = session()
    labelled = spark.read.parquet(args.table).select(F.monotonically_increasing_id().alias("id"), F.col(args.text).alias("text"), F.col(args.label).alias("language"))
    model = NaiveBayes(labelled.where("text is not null and language is not null").cache())
    model.save(args.out)
    print(f"Learned {NaiveBayes.load(spark, args.out).languages.count()} languages.")
    return 0


def sidecar(index: str) -> Path:
    return Path(index.removeprefix("file://").rstrip("/") + ".srv")


def index_command(args) -> int:
    if not args.files and not args.git:
        raise ValueError("give --files, --git or both")
    if (args.shards is not None and args.shards < 1) or args.max_commits < 1:
        raise ValueError("--shards and --max-commits must be positive")
    spark = session()
    passages = spark.createDataFrame([], PASSAGE)
    if args.files:
        passages = passages.unionByName(scan_directory(spark, args.files))
    if args.git:
        passages = passages.unionByName(scan_commits(spark, args.git, args.max_commits))
    store = Store(spark, args.out)
    records = to_records(passages, language_of(args, spark)).cache()
    shards = args.shards or shards_for(records.count())
    store.save(build(records, embedder_of(args), shards=shards), shards)
    print(f"Indexed {store.load().count()} passages.")
    return 0


def ask(index: str, request: dict) -> dict | None:
    """The answer of a running service, or None if there is none."""
    place = sidecar(index)
    try:
        about = json.loads(place.read_text())
        os.kill(about["pid"], 0)
        with socket.create_connection(("127.0.0.1", about["port"]), timeout=CONNECT_S) as s:
            s.settimeout(READ_S)
            s.sendall((json.dumps(request | {"token": about["token"]}) + "\n").encode())
            return json.loads(s.makefile().readline() or "null")
    except (OSError, ValueError, KeyError):
        return None


def search_command(args) -> int:
    warm = ask(args.index, {"command": "console", "query": args.query, "top": args.top, "language": args.lang, "source": args.source})
    if warm and not warm.get("error"):
        print(warm["console"])
        return 0
    spark = session()
    print(SearchService(spark, Store(spark, args.index).load(), embedder_of(args)).console(args.query, top=args.top, language=args.lang, source=args.source))
    return 0


class Service:
    """A resident session: a live index over a folder, queries by socket, console or tool calls."""

    def __init__(self, args):
        self.spark = spark = session()
        self.store, self.embedder, language = Store(spark, args.index), embedder_of(args), language_of(args, spark)
        root, place = args.files, args.index.rstrip("/")
        feed = args.changes or (place + ".changes" if args.watch else None)
        watcher = FolderWatcher(spark, root, feed, place + ".listing") if args.watch else None
        if not self.store.exists():
            if watcher:  # listed before it is read, so that what changes meanwhile is seen later
                watcher.baseline()
            records = to_records(scan_directory(spark, root), language).cache()
            shards = shards_for(records.count())
            self.store.save(build(records, self.embedder, shards=shards), shards)
            records.unpersist()

        def passages_of(paths):
            # a burst's paths, which the driver must list anyway to ask git
            return scan_paths(spark, root, [r["path"] for r in paths.distinct().collect()], check_ignored=False)

        def ignored(paths):
            named = [r["path"] for r in paths.distinct().collect()]
            return spark.createDataFrame([(p,) for p in git_ignored(root, named)], "path string")

        self.live = LiveIndex(self.store, passages_of, self.embedder, language, ignored=ignored)
        self.query, self.closing, self.watching = None, threading.Event(), None
        if feed:
            self.query = self.live.start(change_feed(spark, feed), place + ".checkpoint", args.debounce)
        if watcher:
            self.watching = threading.Thread(target=self.watch, args=(watcher, args.watch / 1000), daemon=True)
            self.watching.start()

    def watch(self, watcher: FolderWatcher, seconds: float) -> None:
        """Poll until the service closes; a poll that fails is said and tried again."""
        while not self.closing.wait(seconds):
            try:
                watcher.poll()
            except Exception as e:  # noqa: BLE001 - a listing may fail for a while
                print(f"watch: {e}", file=sys.stderr)

    def respond(self, request: str) -> str:
        return SearchService(self.spark, self.live.index(), self.embedder).respond(request)

    def listen(self, index: str) -> socketserver.ThreadingTCPServer:
        token, service = secrets.token_hex(16), self

        class Handler(socketserver.StreamRequestHandler):
            timeout = READ_S

            def handle(self):
                line = self.rfile.readline(1 << 20).decode("utf-8", "replace")
                try:
                    asked = json.loads(line)
                    known = secrets.compare_digest(str(asked.get("token")), token)
                except (ValueError, AttributeError):
                    asked, known = {}, False
                answer = service.respond(line) if known else json.dumps({"error": "not allowed", "stopped": False, "results": []})
                self.wfile.write((answer + "\n").encode())
                if known and asked.get("command") == "stop":
                    threading.Thread(target=self.server.shutdown, daemon=True).start()

        server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
        place = sidecar(index)
        place.touch(mode=0o600)
        place.write_text(json.dumps({"port": server.server_address[1], "token": token, "pid": os.getpid()}))
        return server

    def close(self, index: str) -> None:
        self.closing.set()
        if self.watching:
            self.watching.join()
        if self.query:
            self.query.processAllAvailable()
            self.query.stop()
        sidecar(index).unlink(missing_ok=True)


def console_loop(service: Service, lines) -> None:
    for line in lines:
        text = line.strip()
        if text in (":quit", ":q"):
            return
        if text == ":count":
            index = service.live.index()
            files = index.records.where("source = 'file'").agg(F.count_distinct(location_path("location"))).first()[0]
            print(f"{index.count()} passages, {files} files")
        elif text:
            print(SearchService(service.spark, service.live.index(), service.embedder).console(text))


# fixed values: the one tool's name and arguments
TOOL = {"name": "search", "description": "Hybrid search over the indexed passages.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "top": {"type": "integer", "default": TOP}}, "required": ["query"]}}


def tool_answer(message: dict, search) -> dict | None:
    """The reply to one JSON-RPC message of the tool protocol; None where none is due."""
    method, number = message.get("method"), message.get("id")
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": message.get("params", {}).get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "strandline", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [TOOL]}}
    if method == "tools/call":
        params = message.get("params", {})
        given = params.get("arguments") or {}
        text, bad = str(given.get("query") or "").strip(), params.get("name") != TOOL["name"]
        if bad or not text:
            said = "unknown tool" if bad else "a query is required"
            return reply | {"result": {"isError": True, "content": [{"type": "text", "text": said}]}}
        return reply | {"result": {"isError": False, "content": [{"type": "text", "text": search(text, int(given.get("top", TOP)))}]}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve_command(args) -> int:
    service = Service(args)
    server = service.listen(args.index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        console_loop(service, sys.stdin)
    finally:
        server.shutdown()
        service.close(args.index)
    return 0


def mcp_command(args) -> int:
    service = Service(args)
    try:
        for line in sys.stdin:
            if line.strip():
                answer = tool_answer(json.loads(line), lambda q, top: SearchService(service.spark, service.live.index(), service.embedder).tool_text(q, top))
                if answer is not None:
                    print(json.dumps(answer), flush=True)
    finally:
        service.close(args.index)
    return 0


def stop_command(args) -> int:
    answer = ask(args.index, {"command": "stop"})
    print("Stopped." if answer and answer.get("stopped") else "Nothing is running.")
    return 0 if answer and answer.get("stopped") else 1


def install_mcp_command(args) -> int:
    """Add the server to a repository's tool configuration, keeping what is there."""
    place = Path(args.repository) / ".github" / "mcp.json"
    config = json.loads(place.read_text()) if place.exists() else {}
    config.setdefault("servers", {})["strandline"] = {"type": "stdio", "command": sys.executable, "args": ["-m", "strandline.cli", "mcp", "--files", args.files, "--index", args.index]}
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(json.dumps(config, indent=2) + "\n")
    return 0


def install_skill_command(args) -> int:
    """Write a short guide for agents on how to search the repository."""
    place = Path(args.repository) / ".github" / "skills" / "strandline" / "SKILL.md"
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text("---\nname: strandline\ndescription: Search this repository's files and commits.\n---\n\nRun `python -m strandline.cli search \"words\" --index INDEX` and open the places it prints.\n")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, model=True):
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        if model:
            c.add_argument("--vocabulary", default=None)
            c.add_argument("--matrix", default=None)
            c.add_argument("--language-model", default=None)
        return c

    c = command("train-language", train_language_command, model=False)
    c.add_argument("--table", required=True)
    c.add_argument("--text", default="text")
    c.add_argument("--label", default="lang")
    c.add_argument("--out", required=True)
    c = command("index", index_command)
    c.add_argument("--files")
    c.add_argument("--git")
    c.add_argument("--max-commits", type=int, default=500)
    c.add_argument("--out", required=True)
    c.add_argument("--shards", type=int, help="by the number of passages, if not given")
    c = command("search", search_command)
    c.add_argument("query")
    c.add_argument("--index", required=True)
    c.add_argument("--lang")
    c.add_argument("--source", choices=("file", "git"))
    c.add_argument("--top", type=int, default=TOP)
    for name, run in (("serve", serve_command), ("mcp", mcp_command)):
        c = command(name, run)
        c.add_argument("--files", required=True)
        c.add_argument("--index", required=True)
        c.add_argument("--changes", help="folder in which JSON change lines land: " + ", ".join(CHANGE.names))
        c.add_argument("--watch", type=int, default=0, help="list the files every so many milliseconds and apply what changed")
        c.add_argument("--debounce", type=int, default=DEBOUNCE_MS)
    command("stop", stop_command, False).add_argument("--index", required=True)
    c = command("install-mcp", install_mcp_command, False)
    c.add_argument("--repository", default=".")
    c.add_argument("--files", default=".")
    c.add_argument("--index", default=".strandline")
    command("install-skill", install_skill_command, False).add_argument("--repository", default=".")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
