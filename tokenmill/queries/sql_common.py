"""SQL fragments shared by the DuckDB twins (same rules as the Spark side)."""

# corpus view of `documents` with the fixture score
CORPUS = """corpus AS (
  SELECT doc_id, text, CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS score,
         CAST(doc_id AS VARCHAR) AS __index__, source, lang
  FROM documents)"""

BUCKET_CASE = """CASE WHEN isnan(score) THEN NULL
       WHEN score >= 0.6::DOUBLE AND score < 0.75::DOUBLE THEN 'score_0.6_to_0.75'
       WHEN score >= 0.75::DOUBLE AND score <= 1.0::DOUBLE THEN 'score_0.75_to_1.0' END"""

CLASSIFIED = f"""classified AS (
  SELECT *, {BUCKET_CASE} AS bucket FROM corpus)"""


def token_ids(text: str = "text") -> str:
    return (f"list_transform(regexp_extract_all(coalesce({text}, ''), '[^ \\t\\r\\n]+'), "
            "lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 50000 + 16)")


def blocks_cte(src: str, length: int, stride: int, min_len: int, pad: int = 0,
               name: str = "blocks") -> str:
    """Closed-form sliding windows over `src(doc_id, ids)`: one row per block."""
    return f"""{name}_starts AS (
  SELECT doc_id, ids, n,
         CASE WHEN n <= {length} THEN [0]
              ELSE list_filter(range(0, greatest(0, (n - {length} + {stride - 1}) // {stride}) * {stride} + 1, {stride}),
                               lambda s: s < n AND least({length}, n - s) >= {min_len}) END AS starts
  FROM (SELECT doc_id, ids, len(ids) AS n FROM {src})),
{name}_pos AS (
  SELECT doc_id, ids, n, unnest(starts) AS s, CAST(generate_subscripts(starts, 1) - 1 AS INTEGER) AS chunk_idx
  FROM {name}_starts),
{name} AS (
  SELECT doc_id, chunk_idx, s AS start_pos,
         list_resize(list_slice(ids, s + 1, s + {length}), {length}, {pad}::BIGINT) AS input_ids,
         list_resize(list_resize([]::INTEGER[], least({length}, n - s), 1), {length}, 0) AS attention_mask
  FROM {name}_pos)"""


def csv(arr: str) -> str:
    return f"array_to_string({arr}, ',')"
