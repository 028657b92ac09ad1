"""A store for tests: one SQLite file that all processes open, with the statements of the graph format."""

import json
import os
import sqlite3

from quirefold.sources import graph_format


class Result(dict):
    def single(self):
        return self


class Session:
    def __init__(self):
        self.db = sqlite3.connect(os.environ["GRAPH_DOUBLE"], timeout=60)
        self.db.executescript("create table if not exists node(id text primary key, row text); create table if not exists edge(a text, b text, row text, primary key (a, b)); create table if not exists staged(run text, part text, row text); create table if not exists ran(statement text)")

    def run(self, statement, **given):
        self.db.execute("insert into ran values (?)", (statement,))
        out = Result(n=0)
        if statement == graph_format.STAGE:
            rows = [json.dumps(r) for r in given["rows"]]
            if any("poison" in r for r in rows):
                raise RuntimeError("the store refuses")
            self.db.executemany("insert into staged values (?, ?, ?)", [(given["run"], given["part"], r) for r in rows])
        elif statement in graph_format.PLACE.values():
            found = [r for r in self.db.execute("select rowid, part, row from staged where run = ?", (given["run"],)) if r[1] in given["parts"]][: given["most"]]
            self.db.executemany("delete from staged where rowid = ?", [(r[0],) for r in found])
            for r in (json.loads(x[2]) for x in found):
                if statement == graph_format.PLACE["nodes"]:
                    self.db.execute("insert or replace into node values (?, ?)", (r["node_id"], json.dumps(r)))
                elif self.db.execute("select count(*) from node where id in (?, ?)", (r["parent_id"], r["child_id"])).fetchone()[0] == 2:
                    self.db.execute("insert or replace into edge values (?, ?, ?)", (r["parent_id"], r["child_id"], json.dumps(r)))
            out["n"] = len(found)
        elif statement == graph_format.DROP:
            out["n"] = self.db.execute("delete from staged where rowid in (select rowid from staged where run = ? limit ?)", (given["run"], given["most"])).rowcount
        elif statement == graph_format.WIPE_SOME:
            out["n"] = self.db.execute("delete from node where id in (select id from node limit ?)", (given["most"],)).rowcount
            self.db.execute("delete from edge")
        self.db.commit()
        return out

    def close(self):
        self.db.close()
