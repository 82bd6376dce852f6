"""Views that give the plain star-schema tables the shape of the corpus tables. The SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "fx_files": """SELECT source AS repo_id, CAST(doc_id AS STRING) AS file_id,
  concat(lang, '/d', CAST(doc_id % 10 AS STRING), '/doc', CAST(doc_id AS STRING),
    CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.md' ELSE '.bin2' END) AS path,
  text AS content FROM documents""",
    "fx_symbols": """SELECT concat('r', CAST(p_partkey % 4 AS STRING)) AS repo_id, CAST(p_partkey AS STRING) AS symbol_id,
  concat('r', CAST(p_partkey % 4 AS STRING), '/', p_type, '/', p_brand) AS file_id,
  concat(lower(p_type), '/', p_brand, '.ts') AS path, p_name AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'interface' WHEN 4 THEN 'type' ELSE 'enum' END AS kind,
  p_size AS start_line, p_size + CAST(p_partkey % 200 AS INT) AS end_line FROM part""",
    "fx_symbol_files": """SELECT repo_id, file_id, path, CASE WHEN path LIKE 's%' THEN NULL ELSE 'typescript' END AS language,
  max(end_line) AS line_count, CAST(30 * max(end_line) AS BIGINT) AS size_bytes FROM fx_symbols GROUP BY repo_id, file_id, path""",
    "fx_symbol_chunks": '''SELECT repo_id, file_id, symbol_id AS chunk_id, CAST(ceil(length(name) / 4.0) AS INT) AS token_count,
  concat(CASE start_line WHEN 1 THEN '// ' WHEN 2 THEN '/* ' WHEN 3 THEN '# ' WHEN 4 THEN '"""' ELSE '' END, name) AS content FROM fx_symbols''',
    "fx_relations": """SELECT DISTINCT concat('r', CAST(src % 4 AS STRING)) AS repo_id, CAST(src AS STRING) AS src, CAST(dst AS STRING) AS dst,
  CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'imports' ELSE 'extends' END AS relation_type
FROM (SELECT l_partkey AS src, l_linenumber,
        lead(l_partkey) OVER (PARTITION BY l_orderkey, l_partkey % 4
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst
      FROM lineitem) w
WHERE dst IS NOT NULL AND src <> dst""",
    "fx_chunks": """SELECT source AS repo_id, CAST(doc_id AS STRING) AS chunk_id, CAST(doc_id % 97 AS STRING) AS file_id,
  concat(CASE doc_id % 7 WHEN 0 THEN '// ' WHEN 1 THEN '# ' ELSE '' END, text) AS content,
  CAST(doc_id AS STRING) AS symbol_id, CAST(ceil(length(text) / 4.0) AS INT) AS token_count FROM documents""",
    "fx_src": """SELECT repo_id, file_id, k, g, path, language, content, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count,
  CAST(length(content) AS BIGINT) AS size_bytes FROM (
 SELECT concat('r', CAST(g % 4 AS STRING)) AS repo_id, CAST(doc_id AS STRING) AS file_id, k, g,
  replace(replace(replace(replace(replace(replace(CASE k WHEN 0 THEN 'src/app/api/m#M/d#D/[id]/route.ts'
   WHEN 1 THEN 'src/app/api/n#M/d#D/route.ts'
   WHEN 2 THEN 'src/pages/api/v#M/d#D/[...rest].ts'
   WHEN 3 THEN 'src/server/r#M/d#D.js'
   WHEN 4 THEN 'api/f#M/d#D.py'
   WHEN 5 THEN 'svc/k#M/d#D.py'
   WHEN 6 THEN 'src/mod/g#G/service.ts'
   WHEN 7 THEN 'src/#L/g#G/queries.ts'
   WHEN 8 THEN 'src/events/e#D.ts'
   WHEN 9 THEN 'src/mod/g#G/index.ts'
   WHEN 10 THEN 'go/p#D/main.go'
   WHEN 11 THEN 'rust/p#D/lib.rs'
   WHEN 12 THEN 'java/p#D/A.java'
   WHEN 13 THEN 'cs/p#D/A.cs'
   WHEN 14 THEN 'rb/p#D/a.rb'
   ELSE CASE g % 3 WHEN 0 THEN 'kt/p#D/a.kt' WHEN 1 THEN 'swift/p#D/a.swift' WHEN 2 THEN 'php/p#D/a.php' END END, '#M', CAST(doc_id % 10 AS STRING)), '#D', CAST(doc_id AS STRING)), '#G', CAST(g AS STRING)), '#L', CASE WHEN g % 2 = 0 THEN 'mod' ELSE 'lib' END), '#A', CAST(doc_id - 3 AS STRING)), '#S', CAST(doc_id - 3 AS STRING)) AS path,
  CASE k WHEN 0 THEN 'typescript'
   WHEN 1 THEN 'typescript'
   WHEN 2 THEN 'typescript'
   WHEN 3 THEN 'javascript'
   WHEN 4 THEN 'python'
   WHEN 5 THEN 'python'
   WHEN 6 THEN 'typescript'
   WHEN 7 THEN 'typescript'
   WHEN 8 THEN 'typescript'
   WHEN 9 THEN 'typescript'
   WHEN 10 THEN 'go'
   WHEN 11 THEN 'rust'
   WHEN 12 THEN 'java'
   WHEN 13 THEN 'csharp'
   WHEN 14 THEN 'ruby'
   ELSE CASE g % 3 WHEN 0 THEN 'kotlin' WHEN 1 THEN 'swift' WHEN 2 THEN 'php' END END AS language,
  concat(replace(replace(replace(replace(replace(replace(replace(CASE k WHEN 0 THEN 'import { H#M, K as L } from "@/m#M"~export async function GET(req) {~  const { name, age: years } = await req.json()~  const q = url.searchParams.get("q")~  try {~    requireSession(req)~    const r = db.select().from(users)~    return NextResponse.json(r)~  } catch (e) { }~}~export { POST, Helper }~'
   WHEN 1 THEN 'export async function POST(request) {~  const h = request.headers.get("x-key")~  await fetch("https://api#M.example.com/v1/x")~  return Response(JSON.stringify(1))~}~'
   WHEN 2 THEN 'export default function handler(req, res) {~  if (req.method === "PUT") { res.json(1) }~  if (req.method === "DELETE") { const x = req.query.page }~}~'
   WHEN 3 THEN 'const app = express()~app.get("/u#M/:uid", h)~router.route("/w#M").get(a).post(b)~fetch("/api/m#M/d#A")~function send_mail() { return 1 }~function sendMail() { return 2 }~'
   WHEN 4 THEN 'import os~@app.get("/items/{id}")~async def skip():~    pass~def read_item(id):~    current_user = 1~~    return id~~class Store(Base):~    def get(self):~        return 1~'
   WHEN 5 THEN 'from flask import Flask~@app.route("/flask#M", methods=["GET", "POST"])~def page():~    return 1~'
   WHEN 6 THEN 'import { A } from "@scope/pkg#M"~export class S#D extends Base#M implements One, Two {~  static instance: S~  make(kind) {~    switch (kind) { case 1: return new Widget() }~  }~}~export function build(a, b, c, d, e, f) {~  return new Thing()~}~'
   WHEN 7 THEN 'import { build } from "../../mod/g#G/service"~export function find#M() {~  return prisma.user.findMany()~}~'
   WHEN 8 THEN 'class Bus {~  emitter = new EventEmitter()~  start() { this.emitter.on("a", f); this.emitter.emit("a") }~}~'
   WHEN 9 THEN 'export class Index#D extends S#S {~}~export const make = (x) => x~export type T = string~'
   WHEN 10 THEN 'package main~import (~  "fmt"~)~func (s *S) Run(x int) error {~  return nil~}~type Store struct {~}~type Able interface {~}~'
   WHEN 11 THEN 'use std::io~pub async fn run(x: i32) -> i32 {~  x~}~pub struct St {~}~pub trait Tr {~}~enum En {~}~'
   WHEN 12 THEN 'import java.util.List;~public class A#D {~  public static int run(int x) { return x; }~}~interface B {~}~enum C {~}~'
   WHEN 13 THEN 'using System.Text;~public sealed class Q {~  private static int Go(int x) { return x; }~}~'
   WHEN 14 THEN 'require "json"~module Mo~  class Ru~    def self.go?~    end~  end~end~'
   ELSE CASE g % 3 WHEN 0 THEN 'import kotlin.io~open class Ko {~  suspend fun go() { }~}~interface Ki~' WHEN 1 THEN 'import Foundation~protocol Pr {~}~public struct Sw {~  static func go() { }~}~' WHEN 2 THEN 'abstract class Ph {~  public function go($x) { }~}~interface Pi {~}~' END END, '#M', CAST(doc_id % 10 AS STRING)), '#D', CAST(doc_id AS STRING)), '#G', CAST(g AS STRING)), '#L', CASE WHEN g % 2 = 0 THEN 'mod' ELSE 'lib' END), '#A', CAST(doc_id - 3 AS STRING)), '#S', CAST(doc_id - 3 AS STRING)), '~', chr(10)), text) AS content
 FROM (SELECT doc_id, doc_id % 16 AS k, CAST((doc_id - doc_id % 16) / 16 AS BIGINT) AS g, text FROM documents) d) s""",
    "fx_src_symbols": """SELECT repo_id, concat(file_id, ':', part) AS symbol_id, file_id, path, CASE WHEN part = 'f' THEN CASE k WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 3 THEN 'send_mail' WHEN 6 THEN 'build'
   WHEN 8 THEN 'startBus' ELSE concat('fn', file_id) END ELSE concat('Class', part, file_id) END AS name, CASE WHEN part = 'f' THEN 'function' WHEN part = 'c' THEN 'class' ELSE 'method' END AS kind,
  CASE WHEN part = 'f' THEN 2 ELSE 1 END AS start_line, CASE WHEN part = 'f' THEN 4 ELSE line_count END AS end_line,
  CASE WHEN k = 6 THEN 'build(a, b, c, d, e, f)' ELSE 'go(a, b)' END AS signature,
  CASE part WHEN 'd1' THEN concat(file_id, ':c') WHEN 'd2' THEN concat(file_id, ':d1') WHEN 'd3' THEN concat(file_id, ':d2') END AS parent_symbol_id
 FROM fx_src, (SELECT 'f' AS part UNION ALL SELECT 'c' UNION ALL SELECT 'd1' UNION ALL SELECT 'd2' UNION ALL SELECT 'd3') p
 WHERE k < 10 AND k <> 2 AND (part = 'f' OR (part = 'c' AND k IN (6, 8, 9)) OR (part LIKE 'd%' AND k = 8))""",
    "fx_src_relations": """SELECT repo_id, concat(a, ':f') AS src, concat(b, ':f') AS dst, relation_type FROM (
  SELECT repo_id, file_id AS a, CAST(CAST(file_id AS BIGINT) + 6 - k AS STRING) AS b, CASE k WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' ELSE 'imports' END AS relation_type, k, g FROM fx_src WHERE k IN (0, 1, 7)
  UNION ALL SELECT repo_id, file_id, CAST(CAST(file_id AS BIGINT) + 1 AS STRING), 'imports', k, g FROM fx_src WHERE k = 6 AND g % 3 = 0
  UNION ALL SELECT repo_id, file_id, CAST(CAST(file_id AS BIGINT) + 2 AS STRING), 'calls', k, g FROM fx_src WHERE k = 6
  UNION ALL SELECT repo_id, file_id, CAST(CAST(file_id AS BIGINT) + 64 AS STRING), CASE WHEN g % 2 = 0 THEN 'calls' ELSE 'extends' END, k, g FROM fx_src WHERE k = 6) e
 WHERE concat(repo_id, '/', a) IN (SELECT concat(repo_id, '/', file_id) FROM fx_src) AND concat(repo_id, '/', b) IN (SELECT concat(repo_id, '/', file_id) FROM fx_src)""",
    "fx_src_chunks": """SELECT repo_id, file_id AS chunk_id, file_id, path AS file_path, path, language, 1 AS start_line, CAST(line_count AS INT) AS end_line, content,
  CAST(ceil(length(content) / 4.0) AS INT) AS token_count, concat(file_id, ':f') AS symbol_id FROM fx_src""",
    "fx_messages": """SELECT doc_id AS message_id, concat(CASE doc_id % 2 WHEN 0 THEN 'short ' ELSE text END, CASE doc_id % 3
  WHEN 0 THEN concat(' [file:', lang, '/d', CAST(doc_id % 10 AS STRING), '/doc', CAST(doc_id AS STRING), '.ts:L1-L2]') WHEN 1 THEN ' [file:none.ts:L1-L2]' ELSE '' END) AS content FROM documents""",
    "fx_commits": """SELECT concat('r', CAST(o_custkey % 7 AS STRING)) AS repo_id, CAST(o_orderkey AS STRING) AS sha, CAST(o_custkey AS STRING) AS author, o_orderdate AS ts, o_orderpriority AS message FROM orders""",
    "fx_commit_files": """SELECT concat('r', CAST(o_custkey % 7 AS STRING)) AS repo_id, CAST(l_orderkey AS STRING) AS sha, concat(lower(p_type), '/', p_brand, '.ts') AS path,
  CAST(l_quantity AS INT) AS additions, CAST(round(l_discount * 100) AS INT) AS deletions,
  p_size AS change_start, p_size + CAST(l_quantity AS INT) AS change_end FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""",
    "fx_fork_files": """SELECT concat('r', CAST(p_partkey % 4 AS STRING)) AS repo_id, CAST(l_orderkey AS STRING) AS sha, concat(lower(p_type), '/', p_brand, '.ts') AS path,
  p_size AS change_start, p_size + CAST(l_quantity AS INT) AS change_end FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "fx_candidates": """SELECT l_orderkey AS query_id, concat('f', CAST(l_suppkey % 2 AS STRING)) AS file_path,
  CAST(l_partkey AS STRING) AS chunk_id, CASE l_linenumber % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'lexical' ELSE 'structural' END AS strategy,
  CAST(l_quantity AS INT) * 40 AS token_count, CAST(floor(max(l_extendedprice)) AS BIGINT) AS score
FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "fx_citations": """SELECT doc_id AS message_id, concat('see [file:', lang, '/d', CAST(doc_id % 10 AS STRING), '/doc', CAST(doc_id AS STRING), '.ts:L1-L', CAST(doc_id % 40 AS STRING), '] and [file:none.ts:L1-L2]') AS content FROM documents""",
}
_USES = {
    "fx_symbol_files": ["fx_symbols"], "fx_symbol_chunks": ["fx_symbols"], "fx_src_symbols": ["fx_src"], "fx_src_relations": ["fx_src"], "fx_src_chunks": ["fx_src"],
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view of the folder's tables."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for used in (*BASE, *_USES.get(name, [])):
        if f" {used}" in text:
            frame(spark, sf_dir, used).createOrReplaceTempView(used)
    return spark.sql(text)


def sql(*views: str, body: str) -> str:
    """DuckDB SQL: the views as CTEs before body."""
    needed = [v for name in views for v in (*_USES.get(name, []), name)]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in dict.fromkeys(needed))
    text = body.strip()
    if not text.lower().startswith("with "):
        return f"WITH {ctes} {text}"
    text = text[5:]
    recursive = text.startswith("RECURSIVE ")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {text.removeprefix('RECURSIVE ')}"
