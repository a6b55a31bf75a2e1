"""SQL fragments and full statements that a second engine runs over the same tables."""

from __future__ import annotations

RUN = r"[\p{L}\p{Nd}]+"
PIECE = r"\p{Nd}+|\p{Lu}+[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]*|[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+"


def tokens(source: str, name: str = "tok") -> str:
    """CTEs for (id, term), a row per token, of a table or CTE with id and t."""
    return f"""
{name}_run as (select id, unnest(regexp_extract_all(t, '{RUN}')) r from {source}),
{name}_piece as (select id, r, regexp_extract_all(r, '{PIECE}') p from {name}_run),
{name} as (select id, lower(unnest(case when len(p) > 1 then list_append(p, r) else p end)) term from {name}_piece)"""


def postings(source: str, name: str) -> str:
    """CTEs {name}_tf (id, term, tf), {name}_dl (id, dl), {name}_n (n, avgdl)."""
    return f"""{tokens(source, name)},
{name}_tf as (select id, term, count(*) tf from {name} group by all),
{name}_dl as (select s.id, coalesce(sum(tf), 0)::bigint dl from {source} s left join {name}_tf f on f.id = s.id group by s.id),
{name}_n as (select count(*) n, sum(dl)::double / count(*) avgdl from {name}_dl)"""


def hashed(source: str, key: str) -> str:
    """A table with column x: Spark's xxhash64 of a long column, unsigned, by the published steps for eight bytes."""
    # fixed values: the five primes of XXH64
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    word = 1 << 64

    def times(k):  # modulo 2**64, by halves, as a product may have 128 bits
        return f"((x & 4294967295) * {k} + (((x >> 32) * {k & 0xFFFFFFFF}) & 4294967295) * 4294967296) % {word}"

    def turned(n):
        return f"(x << {n}) % {word} + (x >> {64 - n})"

    seed, nulls = 42 + p5 + 8, 42
    steps = [times(p2), turned(31), times(p1), f"xor(x, {seed}::hugeint)", turned(27), f"({times(p1)} + {p4}) % {word}"]
    steps += ["xor(x, x >> 33)", times(p2), "xor(x, x >> 29)", times(p3), "xor(x, x >> 32)"]
    made = f"select ({key}::hugeint + {word}) % {word} x from {source}"
    for step in steps:
        made = f"select {step} x from ({made})"
    return f"select coalesce(x, {nulls}) x from ({made})"


def bm25(queries: str, source: str, name: str, k: int) -> str:
    """CTE {name}_top (query_id, id, score, rank): the k best of each query (query_id, t)."""
    renamed = f"{name}_asked as (select query_id id, t from {queries})"
    return f"""{postings(source, name)}, {renamed}, {tokens(f"{name}_asked", f"{name}_q")},
{name}_terms as (select distinct id query_id, term from {name}_q),
{name}_df as (select term, count(*) df from {name}_tf group by term),
{name}_score as (
  select query_id, f.id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) score
  from {name}_terms join {name}_tf f using (term) join {name}_df using (term) join {name}_dl d on d.id = f.id cross join {name}_n group by all),
{name}_top as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from {name}_score) where rank <= {k})"""


def cosine(queries: str, vectors: str, name: str, k: int) -> str:
    """CTE {name}_top of queries (query_id, v) and vectors (id, embedding)."""
    return f"""{name}_score as (select query_id, id, list_cosine_similarity(v::double[], embedding::double[]) score from {queries} cross join {vectors}),
{name}_top as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from {name}_score) where rank <= {k})"""


RECORDS = """records as (
  select doc_id id, case when doc_id % 4 <> 0 then 'file' else 'git' end source,
    case when doc_id % 4 <> 0 then source || '/doc' || doc_id || '.md:1-9' else substr(md5(doc_id::varchar), 1, 7) end as location,
    case when doc_id % 4 <> 0 then 'doc' || doc_id || '.md' else 'Change ' || doc_id || '  (' || source || ', 2024-01-01)' end title,
    lang as language, text
  from documents),
body_docs as (select id, title || ' ' || text t from records),
path_docs as (select id, case when source = 'file' then translate(regexp_replace(location, '^(.+):[^:]*$', '\\1'), '/.', '  ') else title end t from records)"""


def hybrid(queries: str, pool: int, top: int, language: str | None = None, source: str | None = None) -> str:
    """The whole search over RECORDS and the embeddings of the same ids."""
    test = " and ".join([f"language = '{language}'"] * (language is not None) + [f"source = '{source}'"] * (source is not None)) or "true"
    return f"""with {RECORDS}, asked as ({queries}),
pool as (select vec_id id, embedding from embeddings join records on id = vec_id where {test}),
{cosine("asked", "pool", "vec", pool)}, {bm25("asked", "body_docs", "body", "POOL")}, {bm25("asked", "path_docs", "path", "POOL")},
lists as (select query_id, id, score, rank, 'vector' l, 1.0::double w from vec_top union all select query_id, id, score, rank, 'body', 1.0 from body_top union all select query_id, id, score, rank, 'path', 2.0 from path_top),
fused as (select query_id, id, sum(w / (60.0::double + rank)) fused, coalesce(max(score) filter (where l = 'body'), 0) body, coalesce(max(score) filter (where l = 'vector'), 0) vector from lists group by all),
best as (select f.*, source, location, title, language, text, row_number() over (partition by query_id order by round(fused, 9) desc, round(body, 9) desc, round(vector, 9) desc, id) rank from fused f join records using (id) where {test})
select query_id, rank::int rank, id, source, location, title, language, round(fused, 6) score from best where rank <= {top}""".replace("POOL", str(pool))


PASSAGES = r"""with recursive
split as (select doc_id, regexp_split_to_array(text, '\r\n|\r|\n') l from documents),
lines as (select doc_id, case when l[len(l)] = '' then l[:len(l) - 1] else l end l from split),
walk(doc_id, i, start, chars, cut_start, cut_end) as (
  select doc_id, 0, 0, 0, 0, 0 from lines
  union all
  select w.doc_id, w.i + 1,
    case when skip or cut then 0 else st end, case when skip or cut then 0 else ch end, case when cut then st else 0 end, case when cut then w.i + 1 else 0 end
  from (select w.*, line, blank, skip, st, ch, not skip and ((blank and ch >= 600) or ch >= 1200) as cut
    from (select w.*, line, blank, w.start = 0 and blank as skip, case when w.start = 0 then w.i + 1 else w.start end st, w.chars + length(line) + 1 ch
      from (select w.*, l[w.i + 1] line, regexp_matches(l[w.i + 1], '^\s*$') blank from walk w join lines using (doc_id) where w.i < len(l)) w) w) w),
spans as (
  select doc_id, cut_start a, cut_end b from walk where cut_start > 0
  union all select w.doc_id, w.start, w.i from walk w join lines using (doc_id) where w.i = len(l) and w.start > 0),
texts as (select doc_id, a as start_line, b as end_line, trim(array_to_string(l[a:b], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) as passage from spans join lines using (doc_id))
"""
