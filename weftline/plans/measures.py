"""Queries that apply value checks, file signatures and emoji statistics to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.functions import text as T, values as V
from weftline.operators import rules as R
from weftline.plans.base import Tables, query


@query("select p_partkey, (p_size * (p_partkey % 4 + 1)) * (p_size % 3 + 1) = p_size * (p_size % 5 + 1) as matches from part")
def ratio_checks(t: Tables) -> DataFrame:
    """Parts as canvases, against a ratio that some of them have."""
    ratio = F.concat((F.col("p_size") % 5 + 1).cast("string"), F.lit(":"), (F.col("p_size") % 3 + 1).cast("string"))
    return t.part.select("p_partkey", V.ratio_matches(ratio, F.col("p_size") * (F.col("p_partkey") % 4 + 1), F.col("p_size")).alias("matches"))


@query("select p_partkey, p_partkey % 7 >= 2 and p_size % 5 >= 2 and p_size - 1 > 0 and p_partkey % 7 + p_size - 1 <= 38 and p_size % 5 + p_size <= 28 as inside from part")
def box_checks(t: Tables) -> DataFrame:
    """Parts as boxes on a canvas of 40 by 30 with a margin of 2."""
    box = F.struct((F.col("p_partkey") % 7).alias("x"), (F.col("p_size") % 5).alias("y"), (F.col("p_size") - 1).alias("width"), F.col("p_size").alias("height"))
    return t.part.select("p_partkey", V.box_in_canvas(box, F.lit(40), F.lit(30), F.lit(2)).alias("inside"))


@query("select p_partkey, case when p_size % 10 = 0 then false when p_size % 2 = 0 then abs(p_size * 1000 / 1001 - 30) <= 1.5 else abs(p_size - 30) <= 1.5 end as same from part")
def rate_checks(t: Tables) -> DataFrame:
    """Frame rates written as a fraction, as a number, or wrongly."""
    size = F.col("p_size").cast("string")
    rate = F.when(F.col("p_size") % 10 == 0, F.concat(size, F.lit("/0"))).when(F.col("p_size") % 2 == 0, F.concat(size, F.lit("000/1001"))).otherwise(size)
    return t.part.select("p_partkey", V.same_rate(rate, 30.0, 1.5).alias("same"))


@query("select p_partkey, len(w) >= 2 and len(list_distinct(w)) = len(w) and len(list_filter(w, lambda x: trim(x) = '')) = 0 as valid from (select p_partkey, string_split(case when p_size % 9 = 0 then p_name || ' ' || p_name when p_size % 7 = 0 then p_name || '  ' else p_name end, ' ') as w from part)")
def id_array_checks(t: Tables) -> DataFrame:
    """Words of part names as ids, some twice, some blank."""
    name = F.when(F.col("p_size") % 9 == 0, F.concat_ws(" ", "p_name", "p_name")).when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit("  "))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", V.valid_id_array(F.split(name, " "), 2).alias("valid"))


@query(r"select conv_id, turn, not regexp_matches(regexp_replace(text, '[A-Za-z]', ' ', 'g'), '\S') as blank from conversations")
def blank_texts(t: Tables) -> DataFrame:
    """Turns that nothing but letters, which are taken away, and white space makes up."""
    return t.conversations.select("conv_id", "turn", T.is_blank(F.regexp_replace("text", "[A-Za-z]", " ")).alias("blank"))


#: What documents of a language begin with, and the type that makes them.
SIGNATURES = {"en": ("%PDF-1.4", "application/pdf"), "de": ("GIF89a", "image/gif"), "fr": ("ID3", "audio/mpeg")}


@query("select doc_id, case lang " + " ".join(f"when '{k}' then '{v}'" for k, (_, v) in SIGNATURES.items()) + " else 'text/markdown' end as mime, case when lang = 'de' then ascii(text[1]) + 256 * ascii(text[2]) end as width from documents where regexp_matches(text, '^[A-Za-z]{4}')")
def file_signatures(t: Tables) -> DataFrame:
    """Documents behind the first bytes of several kinds of files; a picture's size stands in the letters behind them."""
    begin = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, (v, _) in SIGNATURES.items()], F.lit(""))
    content = F.encode(F.concat(begin, F.col("text")), "UTF-8")
    mime = T.sniff_mime(F.substring(content, 1, 32), F.lit(".md"))
    return t.documents.where(F.col("text").rlike("^[A-Za-z]{4}")).select("doc_id", mime.alias("mime"), T.image_dims(content, mime)["width"].cast("long").alias("width"))


_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


@query(rf"select doc_id, n as n_emoji, adjacent, n <= 2 and not adjacent as ok from (select doc_id, len(regexp_extract_all(e, '{_EMOJI}')) as n, regexp_matches(e, '{_EMOJI}[\x{{FE0F}}\x{{200D}}]*{_EMOJI}') as adjacent from (select doc_id, replace(replace(text, ' the ', '😀'), ' of ', '✅') as e from documents))")
def emoji_marks(t: Tables) -> DataFrame:
    """Documents with two words replaced by emoji."""
    body = F.replace(F.replace("text", F.lit(" the "), F.lit("😀")), F.lit(" of "), F.lit("✅"))
    return R.emoji_stats(t.documents.select("doc_id", body.alias("text")))
