"""``python -m codeloom COMMAND ROOT [ARGUMENTS]``: scans a source tree and answers one question about it as JSON lines.

status | find QUERY | interface NAME | dependencies NAME [DEPTH] | chain FROM TO | file PATH | overview | context QUESTION |
serve [PORT], which answers GET /status, /interfaces, /interface/NAME, /interface/NAME/dependencies, /find?q=QUERY,
/chain?from=A&to=B, /overview and /projects, and POST /scan.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from .api import Project


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def answer(project: Project, command: str, arguments: list[str]) -> list[dict]:
    known: dict[str, Callable] = {
        "status": lambda: rows(project.get_scan_status()), "find": lambda q: rows(project.find_interfaces(q)), "interface": lambda n: rows(project.get_interface(n)), "chain": lambda a, b: rows(project.get_call_chain(a, b)),
        "dependencies": lambda n, depth="3": rows(project.get_dependencies(n, max_depth=int(depth))), "file": lambda f: rows(project.get_file_interfaces(f)), "overview": lambda: rows(project.get_project_overview()[0]),
        "context": lambda q: [{"section": name, "rows": rows(df)} for name, df in project.get_task_context(q).items()],
    }
    if command not in known:
        raise ValueError(f"unknown command: {command}; one of: {', '.join(known)}, serve")
    return known[command](*arguments)


def server(spark: SparkSession, project: Project, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            try:
                if url.path in ("/find", "/chain", "/overview"):
                    order = {"/find": ("q",), "/chain": ("from", "to"), "/overview": ()}[url.path]
                    self.reply(200, answer(project, url.path[1:], [given[k] for k in order]))
                else:
                    self.reply(200, rows(project.resource(unquote(url.path))))
            except KeyError as e:
                self.reply(400, {"error": f"missing parameter: {e.args[0]}"})
            except ValueError as e:
                self.reply(404, {"error": str(e)})

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/scan":
                self.reply(404, {"error": "unknown path"})
                return
            self.reply(200, rows(project.refresh(spark)))

        def log_message(self, *_) -> None:
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(arguments: list[str]) -> int:
    if len(arguments) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    command, root, *rest = arguments
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    try:
        project = Project.scan(spark, root)
        if command == "serve":
            server(spark, project, int(rest[0]) if rest else 8799).serve_forever()
        for row in answer(project, command, rest):
            print(json.dumps(row, default=str))
    except (ValueError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
