"""Registered queries of full-text, vector and hybrid search, with their SQL."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import chunks as C
from notelake.functions.notes import cosine as cosine_of
from notelake.functions.notes import markdown_snippet, source_label, usable_vector
from notelake.functions.tokens import THAI, runs, thai_words, tokens
from notelake.operators import graph as G
from notelake.operators import search as S
from notelake.plans.prelude import LINKS, NOTES, WS
from notelake.session import shared_folder
from notelake.sources.index import PARTS, TextIndex
from notelake.sources.tables import table

TEXT = "replica migration webhook"
PHRASE = '"drain the node"'
TITLE = "title:readme"
BOOLEAN = "+webhook -replica migration"
NOTHING = "zzzqqq"
LIMIT = 10


def _n(spark, folder) -> DataFrame:
    return G.snapshot(table(spark, folder, "notes"))


def _d(notes: DataFrame) -> DataFrame:
    return G.degrees(notes, G.edges(notes))


def _query_vector(vectors: DataFrame) -> DataFrame:
    """The usable vector with the smallest id."""
    return vectors.where(usable_vector("embedding")).orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


def tokenize(spark, folder):
    n = _n(spark, folder).select("vault", "key", F.posexplode(tokens("body")).alias("pos", "term"))
    return n.groupBy("vault", "key").agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"), F.max("pos").cast("long").alias("last"))


def thai_segmented(spark, folder):
    """Thai runs of the bodies cut into words: no word is longer than its run, and together they give it back."""
    n = _n(spark, folder).where(F.regexp_like("body", F.lit(f"[{THAI}]"))).select("vault", "key", F.posexplode(F.regexp_extract_all("body", F.lit(f"[{THAI}]+"), F.lit(0))).alias("ix", "run"))
    cut = n.withColumn("w", thai_words(F.array("run")))
    return cut.select("vault", "key", F.col("ix").cast("long").alias("ix"), "run", (F.size("w") > 0).alias("has_words"), (F.instr("run", F.array_join("w", "")) > 0).alias("covered"))


def text_runs(spark, folder):
    n = _n(spark, folder).select("vault", "key", runs("title").alias("r"))
    return n.select("vault", "key", F.size("r").cast("long").alias("runs"), F.array_join("r", "").alias("whole"))


def term_stats(spark, folder):
    p = S.postings(_n(spark, folder))
    return p.groupBy("field", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("notes"))


def postings(spark, folder):
    return S.postings(_n(spark, folder)).select("vault", "key", "field", "term", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


def _lexical(text):
    def query(spark, folder):
        return S.best(S.lexical(_n(spark, folder), text), LIMIT).select("vault", "key", "score", F.col("rank").cast("long").alias("rank"))

    return query


def fts_ranked_topk(spark, folder):
    n = _n(spark, folder)
    return S.ranked(S.lexical(n, TEXT), _d(n), LIMIT).select("vault", "key", "score", F.col("rank").cast("long").alias("rank"))


def fts_written_index(spark, folder):
    n = _n(spark, folder)
    found = S.lexical(n, TEXT, (S.postings(n), S.lengths(n)))
    return S.best(found, LIMIT).select("vault", "key", "score", F.col("rank").cast("long").alias("rank"))


def _index(spark, folder) -> TextIndex:
    """The written index of a folder's notes, built by the first query of a session that asks for it."""
    name = hashlib.sha256(f"{spark.sparkContext.applicationId} {folder}".encode()).hexdigest()[:16]
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{name}")
    return index if index.exists() else index.build(_n(spark, folder))


def index_build(spark, folder):
    index = _index(spark, folder)
    parts = [index.read(p).agg(F.count("*").alias("rows")).select(F.lit(p).alias("part"), "rows") for p in PARTS]
    return reduce(DataFrame.unionByName, parts)


def fts_stored_topk(spark, folder):
    return _index(spark, folder).search(TEXT, LIMIT).select("vault", "key", "score", F.col("rank").cast("long").alias("rank"))


def search_without_index(spark, folder):
    return S.empty_hits(spark)


def markdown_snippets(spark, folder):
    return _n(spark, folder).select("vault", "key", markdown_snippet(F.concat(F.lit("<b>"), "title", F.lit("</b>\n"), F.substring("body", 1, 80))).alias("shown"))


def highlighted(spark, folder):
    return _words_only(spark, folder).select("vault", "key")


def cosine(spark, folder):
    v = table(spark, folder, "embeddings")
    q = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return v.join(F.broadcast(q), F.lit(True)).select("vec_id", F.round(cosine_of("embedding", "q"), 6).alias("cosine"))


def knn_max_chunk(spark, folder):
    v = table(spark, folder, "vectors")
    return S.semantic(v, _query_vector(v), LIMIT).select("vault", "key", "score", F.col("rank").cast("long").alias("rank"))


def _hybrid(text):
    def query(spark, folder):
        n, v = _n(spark, folder), table(spark, folder, "vectors")
        hits = S.search(n, _d(n), text, LIMIT, v, _query_vector(v))
        return hits.select("vault", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))

    return query


def _words_only(spark, folder):
    n = _n(spark, folder)
    return S.search(n, _d(n), TEXT, LIMIT)


def search_per_vault_limit(spark, folder):
    return _words_only(spark, folder).select("vault", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def search_total_limit(spark, folder):
    return S.total(_words_only(spark, folder), 8).select("vault", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def search_attributed(spark, folder):
    hits = _words_only(spark, folder).select("vault", "key", "rank")
    sources = G.attribution(_n(spark, folder), table(spark, folder, "sources")).select("vault", "key", source_label("source", "license").alias("label"))
    return hits.join(sources, ["vault", "key"], "left").select("vault", "key", F.col("rank").cast("long").alias("rank"), "label")


def search_snippets(spark, folder):
    n = _n(spark, folder)
    return S.with_snippets(_words_only(spark, folder), n, TEXT).select("vault", "key", "title", F.col("rank").cast("long").alias("rank"), "snippet")


def hits_for_keys(spark, folder):
    n, links = _n(spark, folder), table(spark, folder, "note_updates")
    return S.hits_for_keys(n, links.where("title is null and key is not null").select("vault", "key").distinct())


def chunk(spark, folder):
    return C.chunks(_n(spark, folder)).select("vault", "key", "chunk_ix", "chunk")


def passages(spark, folder):
    return C.passages(_n(spark, folder))


_TOK = r"""list_transform(list_filter(regexp_extract_all(regexp_replace({0}, '([\x{{0E00}}-\x{{0E7F}}]+)', ' \1 ', 'g'), '[\x{{0E00}}-\x{{0E7F}}]+|[\p{{L}}\p{{N}}]+'),
lambda t: strlen(t) < 100 and regexp_matches(t, '[\p{{L}}\p{{N}}]')), lambda t: lower(t))"""
_T, _B = _TOK.format("title"), _TOK.format("body")
_TOKENS = f"""{NOTES}, k as (select vault, "key", 'title' field, {_T} tk from n union all select vault, "key", 'body', {_B} from n),
tok as (select vault, "key", field, unnest(range(len(tk))) pos, unnest(tk) term from k)"""


def _bm25(terms: list[str], where: str = "true") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{_TOKENS}, st as (select vault, field, count(*) n, avg(len(tk)) av from k group by 1, 2),
p as (select vault, "key", field, term, count(*) tf from tok where term in ({listed}) group by 1, 2, 3, 4),
df as (select vault, field, term, count(*) df from p group by 1, 2, 3),
sc as (select p.vault, p."key", round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk) / av))), 6) score
  from p join df using (vault, field, term) join st using (vault, field) join k on k.vault = p.vault and k."key" = p."key" and k.field = p.field where {where} group by 1, 2)"""


def _top(source: str, limit: int = LIMIT) -> str:
    return f'select vault, "key", score, row_number() over (partition by vault order by score desc, "key") rank from {source} qualify rank <= {limit}'


_RANKED = f"""{_bm25(TEXT.split())}, {LINKS.split(chr(10), 1)[1]}, pool as ({_top('sc', 3 * LIMIT)}),
dg as (select vault, "key", count(*) d from (select vault, from_key "key" from e union all select n.vault, n."key" from e join n on n.vault = e.vault and n.title = e.target) group by 1, 2),
bs as (select pool.vault, pool."key", round(score * case when d is null then 1 else 1 + 0.25 * least(1.0, ln(1 + d) / ln(13)) end, 6) score from pool left join dg using (vault, "key")),
rk as ({_top('bs')})"""
_USABLE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_KNN = f"""qv as (select cast(embedding as double[]) q from vectors where {_USABLE} order by vec_id limit 1),
cs as (select vault, "key", round(max(list_cosine_similarity(cast(embedding as double[]), q)), 6) score from vectors, qv where {_USABLE} group by 1, 2)"""
_FUSED = f"""sm as ({_top('cs', 3 * LIMIT)}), sk as (select sm.* from sm where (vault, "key") in (select (vault, "key") from n)),
fu as (select coalesce(a.vault, b.vault) vault, coalesce(a."key", b."key") "key", round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) score from {{0}} a full join sk b on a.vault = b.vault and a."key" = b."key"),
fr as ({_top('fu')})"""
_BOOL = f"""with {_bm25(['webhook', 'migration', 'replica'], "p.term <> 'replica'")}, w as (select vault, "key", bool_or(term = 'webhook') w, bool_or(term = 'replica') r from p group by 1, 2), ok as (
select sc.* from sc join w using (vault, "key") where w and not r) {_top('ok')}"""
_PHRASE = f"""with {_TOKENS}, st as (select vault, field, count(*) n, avg(len(tk)) av from k group by 1, 2),
df as (select vault, field, term, count(distinct "key") df from tok where term in ('drain', 'the', 'node') group by 1, 2, 3),
idf as (select vault, field, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) idf from df join st using (vault, field) group by 1, 2),
p as (select a.vault, a."key", a.field, count(*) tf from tok a join tok b on b.vault = a.vault and b."key" = a."key" and b.field = a.field and b.pos = a.pos + 1
  join tok c on c.vault = a.vault and c."key" = a."key" and c.field = a.field and c.pos = a.pos + 2 where a.term = 'drain' and b.term = 'the' and c.term = 'node' group by 1, 2, 3),
sc as (select p.vault, p."key", round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk) / av))), 6) score from p join idf using (vault, field) join st using (vault, field)
  join k on k.vault = p.vault and k."key" = p."key" and k.field = p.field group by 1, 2) {_top('sc')}"""
_WORDS = f"{_RANKED}, fu as (select vault, \"key\", round(1.0 / (60 + rank), 6) score, rank from rk)"

_CHUNKS = f"""{NOTES}, tb as (select vault, "key", title, hash, trim(body, {WS}) b from n),
step as (select vault, "key", title, hash, b, 1 s, 0 e, 0 ix from tb where length(b) > 0 union all
  select vault, "key", title, hash, b, nx, ed, ix + 1 from (select vault, "key", title, hash, b, ix, e + 1 nx, case when length(b) - e <= 900 then length(b)
    when blank > 0 then e + blank when line > 0 then e + line - 1 else e + 900 end ed from (select *,
      case when strpos(reverse(substr(b, e + 450, 451)), chr(10)||chr(10)) > 0 then 899 - strpos(reverse(substr(b, e + 450, 451)), chr(10)||chr(10)) + 1 else 0 end blank,
      case when strpos(reverse(substr(b, e + 451, 450)), chr(10)) > 0 then 900 - strpos(reverse(substr(b, e + 451, 450)), chr(10)) + 1 else 0 end line from step where e < length(b)))),
pc as (select vault, "key", title, hash, row_number() over (partition by vault, "key" order by ix) - 1 chunk_ix, trim(substr(b, s, e - s + 1), {WS}) chunk from step where ix > 0 and length(trim(substr(b, s, e - s + 1), {WS})) > 0)"""
SQL = {
    "chunk": f'with recursive {_CHUNKS} select vault, "key", cast(chunk_ix as int) chunk_ix, chunk from pc',
    "passages": f"""with recursive {_CHUNKS} select vault, "key", hash, cast(chunk_ix as int) chunk_ix, 'passage: '||case when chunk_ix = 0 then title||chr(10)||chr(10)||chunk else chunk end passage from pc
union all select vault, "key", hash, 0, 'passage: '||title from n where length(trim(body, {WS})) = 0""",
    "tokenize": f"""with {_TOKENS} select vault, "key", count(*) n, count(distinct term) terms, max(pos) "last" from tok where field = 'body' group by 1, 2""",
    "thai_segmented": rf"""with {NOTES}, r as (select vault, "key", regexp_extract_all(body, '[\x{{0E00}}-\x{{0E7F}}]+') x from n)
select vault, "key", unnest(range(len(x))) ix, unnest(x) run, true has_words, true covered from r""",
    "text_runs": rf"""with {NOTES} select vault, "key", len(regexp_extract_all(title, '[\x{{0E00}}-\x{{0E7F}}]+|[^\x{{0E00}}-\x{{0E7F}}]+')) runs, title whole from n""",
    "term_stats": f"""with {_TOKENS} select field, term, count(*) tf, count(distinct vault||'/'||"key") notes from tok group by 1, 2""",
    "postings": f"""with {_TOKENS} select vault, "key", field, term, count(*) tf, string_agg(cast(pos as varchar), ' ' order by pos) positions from tok group by 1, 2, 3, 4""",
    "fts_bm25_topk": f"with {_bm25(TEXT.split())} {_top('sc')}",
    "fts_written_index": f"with {_bm25(TEXT.split())} {_top('sc')}",
    "fts_phrase": _PHRASE,
    "fts_title_only": f"""with {_bm25(['readme'], "p.field = 'title'")} {_top('sc')}""",
    "fts_boolean": _BOOL,
    "fts_ranked_topk": f'with {_RANKED} select vault, "key", score, rank from rk',
    "fts_stored_topk": f'with {_RANKED} select vault, "key", score, rank from rk',
    "index_build": f"""with {_TOKENS}, {LINKS.split(chr(10), 1)[1]} select 'postings' part, count(*) "rows" from (select distinct vault, "key", field, term from tok)
union all select 'lengths', count(*) from k union all select 'keys', count(*) from n
union all select 'degrees', count(*) from (select vault, from_key from e union select n.vault, n."key" from e join n on n.vault = e.vault and n.title = e.target)""",
    "search_without_index": """select '' vault, '' "key", 0.0::double score, 1 rank where false""",
    "markdown_snippets": rf"""with {NOTES} select vault, "key", regexp_replace('**'||title||'**'||chr(10)||replace(replace(substr(body, 1, 80), '<b>', '**'), '</b>', '**'), '[\r\n]+', ' ', 'g') shown from n""",
    "highlighted": f'with {_WORDS} select vault, "key" from fu',
    "cosine": """with q as (select cast(embedding as double[]) q from embeddings order by vec_id limit 1)
select vec_id, round(coalesce(list_cosine_similarity(cast(embedding as double[]), q), 0), 6) cosine from embeddings, q""",
    "knn_max_chunk": f"with {_KNN} {_top('cs')}",
    "hybrid_rrf": f'with {_RANKED}, {_KNN}, {_FUSED.format("rk")} select vault, "key", round(score, 6) score, rank from fr',
    "hybrid_rrf_lexical_empty": f"""with {NOTES}, no as (select '' vault, '' "key", 1 rank where false), {_KNN}, {_FUSED.format("no")} select vault, "key", round(score, 6) score, rank from fr""",
    "search_per_vault_limit": f'with {_WORDS} select vault, "key", score, rank from fu',
    "search_total_limit": f'with {_WORDS} select vault, "key", score, rank from fu order by score desc, vault, rank limit 8',
    "search_attributed": f"""with {_WORDS}, h as (select n.vault, n."key", s.name, s.license, row_number() over (partition by n.vault, n."key" order by length(s.prefix) desc, s.name) r
from n join sources s on s.vault = n.vault and (n."key" = s.prefix or starts_with(n."key", s.prefix||'/')))
select fu.vault, fu."key", fu.rank, h.name||' · '||coalesce(nullif(trim(h.license), ''), 'licence not stated') label from fu left join h on h.vault = fu.vault and h."key" = fu."key" and h.r = 1""",
    "hits_for_keys": f"""with {NOTES} select vault, "key", title, substr(body, 1, 150) snippet, cast(0 as double) score from n
where (vault, "key") in (select (vault, "key") from note_updates where title is null and "key" is not null)""",
}
QUERIES = {
    "tokenize": tokenize,
    "text_runs": text_runs,
    "thai_segmented": thai_segmented,
    "term_stats": term_stats,
    "postings": postings,
    "fts_bm25_topk": _lexical(TEXT),
    "fts_written_index": fts_written_index,
    "fts_phrase": _lexical(PHRASE),
    "fts_title_only": _lexical(TITLE),
    "fts_boolean": _lexical(BOOLEAN),
    "fts_ranked_topk": fts_ranked_topk,
    "fts_stored_topk": fts_stored_topk,
    "index_build": index_build,
    "search_without_index": search_without_index,
    "markdown_snippets": markdown_snippets,
    "highlighted": highlighted,
    "cosine": cosine,
    "knn_max_chunk": knn_max_chunk,
    "hybrid_rrf": _hybrid(TEXT),
    "hybrid_rrf_lexical_empty": _hybrid(NOTHING),
    "search_per_vault_limit": search_per_vault_limit,
    "search_total_limit": search_total_limit,
    "search_attributed": search_attributed,
    "search_snippets": search_snippets,
    "hits_for_keys": hits_for_keys,
    "chunk": chunk,
    "passages": passages,
}
