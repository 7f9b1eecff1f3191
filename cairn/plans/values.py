"""Registered queries of the scalar functions and of content rules, each with SQL written independently of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds, paths, values
from ..operators import findings as X, metadata as M
from ..sources.catalog import CATALOG_SQL as CAT, of_documents, table
from .queries import query

_CONTROL = r"[\p{Cc}\x{200E}\x{200F}\x{061C}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
_ODD = "doc_id || chr(8238) || name || chr(7) || '/' || chr(8296)"


@query(f"""WITH {CAT}, o AS (SELECT *, {_ODD} AS odd, trim(regexp_replace(text, '\\p{{Cc}}', ' ', 'g')) AS t, trim(regexp_replace({_ODD} || repeat(' long', doc_id::INT % 20), '{_CONTROL}', '', 'g')) AS g FROM catalog)
SELECT doc_id, CASE WHEN parent = 'src3' THEN '' ELSE parent[6:] END AS location, regexp_replace(odd, '{_CONTROL}', chr(65533), 'g') AS safe, CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END AS cleaned, CASE WHEN length(g) BETWEEN 1 AND 60 THEN g END AS tag,
left(regexp_replace(odd, '[^A-Za-z0-9._ -]', '', 'g'), 32) AS codec, stem || '-sanitized' || x.dot || ',' || stem || '-sanitized-2' || x.dot AS copies FROM o, LATERAL (SELECT CASE WHEN ext = '' THEN '' WHEN ext = 'png' THEN '.PNG' ELSE '.' || ext END AS dot) x""")
def cleaned_texts(spark, d):
    odd = F.concat(F.col("doc_id").cast("string"), F.lit("‮"), "name", F.lit("\x07/⁨"))
    return of_documents(spark, d).select(
        "doc_id", paths.location("path", "src3").alias("location"), paths.display_safe(odd).alias("safe"), values.clean("text").alias("cleaned"), values.clean_tag(F.concat(odd, F.repeat(F.lit(" long"), (F.col("doc_id") % 20).cast("int")))).alias("tag"),
        values.clean_codec(odd).alias("codec"), F.array_join(paths.sanitized_names("name", 2), ",").alias("copies"),
    )


@query("""WITH s AS (SELECT doc_id, strlen(text) * (1 + doc_id % 7 * doc_id % 1000)::BIGINT AS n FROM documents), u AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM s), v AS (SELECT *, n::DOUBLE / pow(1024, k) AS x FROM u)
SELECT doc_id, CASE WHEN k = 0 THEN n || ' B' WHEN x < 10 THEN printf('%.1f', x) || ' ' || ['KB', 'MB', 'GB', 'TB'][k] ELSE round(x)::BIGINT || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS label,
CASE WHEN n >= 3600000 THEN (n // 3600000) || ':' || lpad((n // 60000 % 60)::VARCHAR, 2, '0') ELSE (n // 60000)::VARCHAR END || ':' || lpad((n // 1000 % 60)::VARCHAR, 2, '0') AS duration, strftime(make_timestamp(n * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS moment FROM v""")
def shown_numbers(spark, d):
    n = F.octet_length("text").cast("long") * (1 + F.col("doc_id") % 7 * F.col("doc_id") % 1000)
    return table(spark, d, "documents").select("doc_id", values.human_size(n).alias("label"), values.human_duration(n).alias("duration"), values.format_unix(n).alias("moment"))


@query(f"""WITH {CAT}, b AS (SELECT doc_id, path, encode(path) AS raw FROM catalog), l AS (SELECT doc_id, list_transform(range(0, octet_length(raw)), lambda i: ('0x' || substr(hex(raw), (2 * i + 1)::INT, 2))::HUGEINT) AS bytes FROM b)
SELECT doc_id, lower(lpad(to_hex(list_reduce(bytes, lambda h, x: xor(h, x) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)::UBIGINT), 16, '0')) AS id FROM l""")
def fnv_ids(spark, d):
    return of_documents(spark, d).select("doc_id", values.fnv1a("path").alias("id"))


_PLACE = "CASE doc_id % 9 WHEN 0 THEN '.git/' WHEN 1 THEN 'My.APP/' WHEN 2 THEN '$Recycle.Bin/' WHEN 3 THEN 'a//b\\' WHEN 4 THEN 'found.000/' WHEN 5 THEN 'x.app.txt/' ELSE '' END || CASE doc_id % 5 WHEN 0 THEN path || '/Thumbs.db' WHEN 1 THEN '/' || path || '/' ELSE path END"
_LINK = "CASE doc_id % 6 WHEN 0 THEN '../x' WHEN 1 THEN '../../x' WHEN 2 THEN '../../../x' WHEN 3 THEN '/etc' WHEN 4 THEN 'a/../../../../..' ELSE './b//c/..' END"
_UPS = "[1, 2, 3, 99, 4, 0][(doc_id % 6)::INT + 1]"


@query(f"""WITH {CAT}, p AS (SELECT doc_id, {_PLACE} AS raw, path, parent FROM catalog), n AS (SELECT *, trim(regexp_replace(replace(raw, '\\', '/'), '/+', '/', 'g'), '/') AS normal FROM p)
SELECT doc_id, normal, NOT (regexp_matches(normal, '(^|/)[.]') OR doc_id % 9 IN (1, 2, 4) OR doc_id % 5 = 0) AS listable, {_UPS} > len(string_split(parent, '/')) AS escapes FROM n""")
def listable_paths(spark, d):
    place = paths.normal(F.expr(_PLACE.replace("\\", "\\\\")))
    return of_documents(spark, d).select("doc_id", place.alias("normal"), paths.listable(place).alias("listable"), paths.link_escapes("path", F.expr(_LINK)).alias("escapes"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate + to_seconds((o_orderkey % 86400)::INT) AS ts FROM orders), s AS (SELECT o_orderkey, ts, o_orderkey % 11 = 0 AS bad, o_orderkey % 3 = 0 AS sub, o_orderkey % 4 = 0 AS later FROM t)
SELECT o_orderkey, CASE WHEN NOT bad THEN epoch_ms(ts) END AS ms, CASE WHEN NOT bad OR later THEN CASE WHEN later THEN 86400000 ELSE epoch_ms(ts) END + CASE WHEN sub THEN 50 ELSE 0 END END AS taken, CASE WHEN o_orderkey % 2 = 0 THEN 'Ann X1' ELSE 'Ann' END AS camera FROM s""")
def capture_times(spark, d):
    k = F.col("o_orderkey")
    ts = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=k % 86400)
    said = F.when(k % 11 == 0, F.date_format(ts, "yyyy:13:dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    no = F.lit(None).cast("struct<name: string, value: string>")
    fields = F.array_compact(F.array(field("DateTime", said), F.when(k % 4 == 0, field("DateTimeOriginal", F.lit("1970:01:02 00:00:00"))).otherwise(no), F.when(k % 3 == 0, field("SubSecTimeOriginal", F.lit("05"))).otherwise(no), field("Make", F.lit("Ann")), F.when(k % 2 == 0, field("Model", F.lit("X1"))).otherwise(no)))
    return table(spark, d, "orders").withColumn("c", M.capture(fields)).select("o_orderkey", values.exif_millis(said).alias("ms"), F.col("c.time_ms").alias("taken"), F.col("c.camera").alias("camera"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 90 AS a, c_custkey % 180 AS o, c_custkey % 60 AS m, c_custkey % 2 = 0 AS s, c_custkey % 13 = 0 AS bad FROM customer)
SELECT c_custkey, CASE WHEN NOT bad AND NOT (a = 0 AND o = 0) THEN round(CASE WHEN s THEN -1 ELSE 1 END * (a + 0.25), 6)::DOUBLE END AS lat, CASE WHEN NOT bad AND NOT (a = 0 AND o = 0) THEN o::DOUBLE END AS lon, round(CASE WHEN s THEN -1 ELSE 1 END * (a + m::DOUBLE / 60 + 30.0 / 3600), 6) AS x FROM c WHERE a > 0""")
def coordinates(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").where("c_custkey % 90 > 0")
    sign = F.when(k % 2 == 0, "-").otherwise("+")
    iso = F.when(k % 13 == 0, "48.1,2.3").otherwise(F.concat(sign, F.format_string("%02d.25+%03d/", k % 90, k % 180)))
    xmp = F.concat(F.format_string("%d,%d,30", k % 90, k % 60), F.when(k % 2 == 0, "S").otherwise("N"))
    at = values.iso6709(iso)
    return c.select("c_custkey", F.round(at["lat"], 6).alias("lat"), at["lon"].alias("lon"), F.round(values.xmp_coordinate(xmp), 6).alias("x"))


@query("""SELECT p_partkey, sha256(least(a, b) || '|' || greatest(a, b)) AS key, least(99, round(100 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (p_size::DOUBLE / 40) / 1.13::DOUBLE))))::INT AS similarity, round((p_size::DOUBLE * 2.5 / 5), 6) AS middle FROM (SELECT *, sha256(p_name) AS a, sha256(p_brand) AS b FROM part)""")
def pair_values(spark, d):
    a, b = values.identity_key("p_name"), values.identity_key("p_brand")
    return table(spark, d, "part").select("p_partkey", values.pair_key(a, b).alias("key"), values.similarity(F.col("p_size") / 40.0).alias("similarity"), F.round(F.get(values.sample_times(F.col("p_size").cast("double"), 5), F.lit(2)), 6).alias("middle"))


# ---- types by content: the heads are whole signatures by hand, what they are is told by the SQL's own rules

_HEADS = [
    "FFD8FFE000104A464946", "89504E470D0A1A0A0000000D49484452000000100000000A", "474946383761020003000000", "474946383961000105000000", "524946460000000057454250", "524946460000000057415645", "5249464600000000415649204C495354", "524946460000000041434F4E", "424D00000000000000001A0000000C00000000000000000000",
    "424D0000000000000000360000002800000005000000F9FFFFFF0100", "49492A00080000004352", "4D4D002A0000000800", "4949524F0800", "494952530800", "49495500180000", "46554A4946494C4D4343442D52415720", "00000100010010", "00000100000010", "384250530001",
    *("00000018" + "66747970" + b.encode().hex().upper() for b in ("heic", "heix", "heim", "heis", "mif1", "msf1", "hevc", "hevx", "avif", "avis", "crx ", "qt  ", "M4A ", "M4B ", "M4P ", "3gp4", "3gp5", "3gp6", "3g2a", "3ge6", "3gs7", "M4V ", "M4VH", "M4VP", "M4XX", "isom", "dash")),
    *("00000008" + b.encode().hex().upper() for b in ("moov", "mdat", "wide", "free", "skip", "pnot")), "1A45DFA39F4286810142F7810142F2810442F381084282847765626D", "1A45DFA3A34286810142F7810142F28104", "464C560105", "3026B2758E66CF11A6D9", "000001BA44", "47" + "00" * 187 + "47" + "00" * 187 + "47", "47" + "00" * 187 + "47" + "00" * 187 + "48",
    "664C614300000022", "494433040000", "4F67675300020000" + "00" * 20 + "807468656F7261", "4F67675300020000" + "00" * 20 + "4F70757348656164", "4F67675300020000", "464F524D0000000041494646", "464F524D0000000041494643", "464F524D0000000041494644", "4D54686400000006", "2321414D520A", "FFF15080", "FFF94C80", "FFFB9064", "FFF39064", "FFE01234",
    "FEEDFACE00", "FEEDFACF00", "CEFAEDFE07", "CFFAEDFE07", "CAFEBABE00000002", "CAFEBABE00000013", "CAFEBABE00000014", "CAFEBABE00000034", "CAFEBABE00", "7F454C460201", "4D5A9000", "6465780A30333500", "0061736D01000000", "4C0000000114020000", "46617364554153204C", "23212F62696E2F7368", "255044462D312E34", "7B5C727466315C61", "D0CF11E0A1B11AE1",
    "504B0304" + "00" * 22 + "08000000" + b"mimetypeapplication/epub+zip".hex().upper(), "504B0304" + "00" * 22 + "08000000" + b"mimetypeapplication/vnd.oasis".hex().upper(), "504B0304" + "00" * 22 + "13000000" + b"[Content_Types].xml".hex().upper(), "504B0304" + "00" * 22 + "09000000" + b"_rels/.re".hex().upper() + "00" * 600 + b"[Content_Types].xml".hex().upper(),
    "504B0304" + "00" * 22 + "09000000" + b"META-INF/".hex().upper(), "504B0304" + "00" * 22 + "05000000" + b"a.txt".hex().upper() + b"AndroidManifest.xml".hex().upper(), "504B0304" + "00" * 22 + "05000000" + b"hello".hex().upper(), "504B050600", "504B070800", "1F8B0800", "425A6839", "FD377A585A00", "28B52FFD04", "377ABCAF271C00", "526172211A0700", "78617221001C", "4D53434600",
    "61" * 257 + "7573746172", "303730373037", "303730373031", "303730373032", "53514C69746520666F726D6174203300", "62706C697374303064", "000100000010", "4F54544F00", "7472756500", "7474636600", "774F464600", "774F463200", "774F467800",
    *(t.encode().hex().upper() for t in ("﻿ \n<!DOCTYPE html><p>", "<HTML>", "<head x>", "<script>", "<svg x>", "<?xml version='1.0'?><svg>", "<?xml?><plist>", "<?xml?><!DOCTYPE PropertyList>", "<?xml?><note>", "hello", "a\tb\r\n\x0c", "é漢😀")), "C3", "61E6BC", "61F09F98", "61FF", "61C320", "610B", "0013FF", "EFBBBF68",
]
_LIST = "[" + ", ".join(f"'{h}'" for h in _HEADS) + "]"
#: DuckDB: the types by LIKE over the head in hex, first match first. Underscores stand for one hex digit.
_TYPES_SQL = """CASE WHEN h = '' THEN 'empty' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'gif' WHEN h LIKE '52494646________57454250%' THEN 'webp' WHEN h LIKE '52494646________57415645%' THEN 'wav' WHEN h LIKE '52494646________41564920%' THEN 'avi'
WHEN h LIKE '424D________00000000________________________________%' THEN 'bmp' WHEN h LIKE '49492A00________4352%' OR h LIKE '4D4D002A________4352%' THEN 'cr2' WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'tiff' WHEN h LIKE '4949524F%' OR h LIKE '49495253%' THEN 'orf' WHEN h LIKE '49495500%' THEN 'rw2' WHEN h LIKE '46554A4946494C4D4343442D524157%' THEN 'raf'
WHEN h LIKE '00000100______%' AND h NOT LIKE '0000010000%' THEN 'ico' WHEN h LIKE '38425053%' THEN 'psd' WHEN h LIKE '________66747970________%' THEN CASE WHEN b IN ('heic', 'heix', 'heim', 'heis', 'mif1', 'msf1', 'hevc', 'hevx') THEN 'heif' WHEN b IN ('avif', 'avis') THEN 'avif' WHEN b = 'crx ' THEN 'cr3' WHEN b = 'qt  ' THEN 'mov' WHEN b IN ('M4A ', 'M4B ', 'M4P ') THEN 'm4a' WHEN b IN ('3gp4', '3gp5', '3gp6', '3g2a', '3ge6', '3gs7') THEN '3gp' WHEN b IN ('M4V ', 'M4VH', 'M4VP') THEN 'm4v' ELSE 'mp4' END
WHEN substr(h, 9, 8) IN ('6D6F6F76', '6D646174', '77696465', '66726565', '736B6970', '706E6F74') THEN 'mov' WHEN h LIKE '1A45DFA3%' THEN CASE WHEN contains(left(h, 128), '7765626D') THEN 'webm' ELSE 'mkv' END WHEN h LIKE '464C5601%' THEN 'flv' WHEN h LIKE '3026B2758E66CF11%' THEN 'asf' WHEN h LIKE '000001BA%' THEN 'mpeg' WHEN left(h, 2) = '47' AND substr(h, 377, 2) = '47' AND substr(h, 753, 2) = '47' THEN 'mpegts'
WHEN h LIKE '664C6143%' THEN 'flac' WHEN h LIKE '494433%' THEN 'mp3' WHEN h LIKE '4F676753%' THEN CASE WHEN contains(left(h, 256), '807468656F7261') THEN 'ogv' WHEN contains(left(h, 256), '4F70757348656164') THEN 'opus' ELSE 'ogg' END WHEN h LIKE '464F524D________41494646%' OR h LIKE '464F524D________41494643%' THEN 'aiff' WHEN h LIKE '4D546864%' THEN 'midi' WHEN h LIKE '2321414D52%' THEN 'amr'
WHEN left(h, 4) IN ('FFF0', 'FFF1', 'FFF8', 'FFF9') THEN 'aac' WHEN left(h, 3) IN ('FFE', 'FFF') AND substr(h, 4, 1) NOT IN ('0', '1', '8', '9') THEN 'mp3' WHEN left(h, 8) IN ('FEEDFACE', 'FEEDFACF', 'CEFAEDFE', 'CFFAEDFE') THEN 'macho' WHEN h LIKE 'CAFEBABE________%' THEN CASE WHEN substr(h, 9, 8) BETWEEN '00000001' AND '00000013' THEN 'macho' ELSE 'javaclass' END
WHEN h LIKE '7F454C46%' THEN 'elf' WHEN h LIKE '4D5A%' THEN 'pe' WHEN h LIKE '6465780A%' THEN 'dex' WHEN h LIKE '0061736D%' THEN 'wasm' WHEN h LIKE '4C00000001140200%' THEN 'lnk' WHEN h LIKE '46617364554153%' THEN 'scpt' WHEN h LIKE '2321%' THEN 'shebang' WHEN h LIKE '255044462D%' THEN 'pdf' WHEN h LIKE '7B5C727466%' THEN 'rtf' WHEN h LIKE 'D0CF11E0A1B11AE1%' THEN 'ole'
WHEN left(h, 8) IN ('504B0304', '504B0506', '504B0708') THEN CASE WHEN substr(h, 53, 4) = '0800' AND substr(h, 61, 16) = '6D696D6574797065' THEN CASE WHEN contains(left(h, 400), '6170706C69636174696F6E2F657075622B7A6970') THEN 'epub' ELSE 'odf' END WHEN contains(h, '5B436F6E74656E745F54797065735D2E786D6C') THEN 'ooxml' WHEN substr(h, 61, 18) = '4D4554412D494E462F' OR contains(left(h, 1024), '416E64726F69644D616E69666573742E786D6C') THEN 'jar' ELSE 'zip' END
WHEN h LIKE '1F8B%' THEN 'gzip' WHEN h LIKE '425A68%' THEN 'bzip2' WHEN h LIKE 'FD377A585A00%' THEN 'xz' WHEN h LIKE '28B52FFD%' THEN 'zstd' WHEN h LIKE '377ABCAF271C%' THEN '7z' WHEN h LIKE '526172211A07%' THEN 'rar' WHEN h LIKE '78617221%' THEN 'xar' WHEN h LIKE '4D534346%' THEN 'cab' WHEN substr(h, 515, 10) = '7573746172' THEN 'tar' WHEN left(h, 12) IN ('303730373037', '303730373031', '303730373032') THEN 'cpio'
WHEN h LIKE '53514C69746520666F726D6174203300%' THEN 'sqlite' WHEN h LIKE '62706C6973743030%' THEN 'bplist' WHEN h LIKE '0001000000%' OR left(h, 8) IN ('4F54544F', '74727565', '74746366') THEN 'font' WHEN left(h, 8) IN ('774F4646', '774F4632') THEN 'woff' WHEN regexp_matches(t, '^<(!doctype html|html|head|script)') THEN 'html' WHEN t LIKE '<svg%' OR t LIKE '<?xml%<svg%' THEN 'svg' WHEN t LIKE '<?xml%<plist%' OR t LIKE '<?xml%propertylist%' THEN 'plist' WHEN t LIKE '<?xml%' THEN 'xml'
WHEN s AND NOT regexp_matches(h, '^(..)*(0[0-8B]|0E|0F|1.)') THEN 'text' ELSE 'unknown' END"""
#: A sample's hex, its brand, its text without mark and blanks (lower case), and whether it is UTF-8 but for a part at the end.
_SAMPLES_SQL = f"""s0 AS (SELECT doc_id, {_LIST}[(doc_id % {len(_HEADS)})::INT + 1] AS h FROM documents), s1 AS (SELECT *, regexp_replace(h, '(C3|E6BC|F09F98)$', '') AS cut FROM s0),
s2 AS (SELECT doc_id, h, CASE WHEN substr(h, 17, 8) ~ '^([2-7][0-9A-F]){{4}}$' THEN decode(unhex(substr(h, 17, 8))) ELSE '' END AS b, h ~ '^(..)*$' AND cut ~ '^([0-7].|C[2-9A-F][89AB].|D.[89AB].|E[1-9A-F][89AB].[89AB].|F[0-4][89AB].[89AB].[89AB].)*$' AS s, lower(regexp_replace(CASE WHEN cut ~ '^([0-7].)*$' OR cut LIKE 'EFBBBF%' THEN decode(unhex(regexp_replace(cut, '^EFBBBF', ''))) ELSE '' END, '^[ \\t\\n\\f\\r]+', '')) AS t FROM s1)"""


def _sampled(spark, d):
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int")))
    return of_documents(spark, d).withColumn("content", head).withColumn("size", F.octet_length("content").cast("long"))


@query(f"WITH {_SAMPLES_SQL} SELECT doc_id, {_TYPES_SQL} AS type FROM s2")
def content_types(spark, d):
    return _sampled(spark, d).select("doc_id", kinds.type_of("content", "size").alias("type"))


@query(f"""WITH {CAT}, {_SAMPLES_SQL}, e AS (SELECT s2.*, CASE WHEN doc_id % 2 = 0 THEN ext WHEN doc_id % 3 = 0 THEN 'mov' ELSE 'txt' END AS ext FROM s2 JOIN catalog USING (doc_id)),
n AS (SELECT *, CASE WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN left(h, 12) IN ('474946383761', '474946383961') THEN 'gif' WHEN h LIKE '52494646________57454250%' THEN 'webp' WHEN h LIKE '________66747970________%' THEN CASE WHEN b = 'qt  ' THEN 'mov' WHEN b IN ('heic', 'heix', 'heim', 'heis', 'mif1', 'msf1') THEN 'heif' WHEN b IN ('isom', 'iso2', 'iso4', 'iso5', 'iso6', 'mp41', 'mp42', 'avc1', 'M4V ', 'M4VH', 'M4VP', 'dash', 'mmp4', 'MSNV') THEN 'mp4' ELSE 'unknown' END
WHEN ext = 'mov' AND substr(h, 9, 8) IN ('6D6F6F76', '6D646174', '77696465', '66726565', '736B6970') THEN 'mov' WHEN h LIKE '1A45DFA3%' THEN CASE WHEN contains(h, '7765626D') THEN 'webm' ELSE 'unknown' END WHEN h LIKE '255044462D%' THEN 'pdf' WHEN h LIKE '4D5A%' OR h LIKE '2321%' OR left(h, 8) IN ('7F454C46', 'FEEDFACE', 'FEEDFACF', 'CEFAEDFE', 'CFFAEDFE', 'CAFEBABE') THEN 'executable'
WHEN ext = 'txt' AND s AND NOT regexp_matches(h, '^(..)*(0[0-8B]|0E|0F|1.)') THEN 'text' ELSE 'unknown' END AS class FROM e)
SELECT doc_id, class, ext IN ('jpg', 'png', 'mp4', 'gif', 'pdf', 'mp3', 'mov', 'txt') AND class <> 'executable' AS may_open, CASE ext WHEN 'jpg' THEN 'jpeg' WHEN 'png' THEN 'png' WHEN 'gif' THEN 'gif' WHEN 'pdf' THEN 'pdf' WHEN 'mp4' THEN 'mp4,mov' WHEN 'mov' THEN 'mp4,mov' WHEN 'txt' THEN 'text' END AS claims FROM n""")
def narrow_classes(spark, d):
    ext = F.when(F.col("doc_id") % 2 == 0, F.col("ext")).when(F.col("doc_id") % 3 == 0, "mov").otherwise("txt")
    rows = _sampled(spark, d).withColumn("ext", ext).withColumn("class", kinds.sniff("content", "ext"))
    return rows.select("doc_id", "class", kinds.may_open("ext", "class").alias("may_open"), F.array_join(kinds.claimed_classes("ext"), ",").alias("claims"))


_FACTS_SQL = "doc_id % 3 = 0 AS executable_bit, doc_id % 5 = 0 AS quarantined, doc_id % 7 = 0 AS decode_failed, doc_id % 11 = 0 AS media_blocked, doc_id % 13 = 0 AS broken_container"
_FAMILY_SQL = """CASE WHEN type IN ('jpeg', 'png', 'gif', 'webp', 'bmp', 'cr2', 'tiff', 'orf', 'rw2', 'raf', 'ico', 'psd', 'heif', 'avif', 'cr3') THEN 'image' WHEN type IN ('avi', 'mov', '3gp', 'm4v', 'mp4', 'webm', 'mkv', 'flv', 'asf', 'mpeg', 'mpegts', 'ogv') THEN 'video' WHEN type IN ('wav', 'm4a', 'flac', 'mp3', 'opus', 'ogg', 'aiff', 'midi', 'amr', 'aac') THEN 'audio' WHEN type IN ('macho', 'javaclass', 'elf', 'pe', 'dex', 'wasm', 'lnk', 'jar', 'xar') THEN 'executable' WHEN type IN ('scpt', 'shebang') THEN 'script'
WHEN type IN ('pdf', 'rtf', 'ole', 'epub', 'odf', 'ooxml') THEN 'document' WHEN type IN ('zip', 'gzip', 'bzip2', 'xz', 'zstd', '7z', 'rar', 'cab', 'tar', 'cpio') THEN 'archive' WHEN type IN ('sqlite', 'bplist', 'plist', 'empty') THEN 'data' WHEN type IN ('font', 'woff') THEN 'font' WHEN type IN ('html', 'svg') THEN 'web' WHEN type IN ('xml', 'text') THEN 'text' ELSE 'unknown' END"""
_FITS_SQL = "CASE ext WHEN 'jpg' THEN type = 'jpeg' WHEN 'png' THEN type = 'png' WHEN 'mp4' THEN type IN ('mp4', 'm4v', 'mov', '3gp') WHEN 'gif' THEN type = 'gif' WHEN 'pdf' THEN type = 'pdf' WHEN 'mp3' THEN type = 'mp3' END"


@query(f"""WITH {CAT}, {_SAMPLES_SQL}, y AS (SELECT doc_id, h, {_TYPES_SQL} AS type FROM s2), f AS (SELECT y.*, ext, {_FAMILY_SQL} AS family, {_FITS_SQL} AS fits, {_FACTS_SQL} FROM y JOIN catalog USING (doc_id)), g AS (SELECT *, family IN ('executable', 'script') AS code, coalesce(NOT fits, false) AS wrong FROM f),
c AS (SELECT doc_id, type, family, fits, [CASE WHEN wrong AND code THEN '1disguised-executable' END, CASE WHEN media_blocked THEN '1media-engine-failure' END, CASE WHEN wrong AND NOT code AND type = 'unknown' THEN '2unknown-signature' END, CASE WHEN wrong AND NOT code AND type <> 'unknown' THEN '2extension-mismatch' END, CASE WHEN fits IS NULL AND code THEN '2unexpected-executable' END, CASE WHEN executable_bit AND family IN ('image', 'video', 'audio', 'document') THEN '2executable-bit' END,
CASE WHEN type = 'bmp' AND substr(h, 37, 8) = '00000000' THEN '2invalid-dimensions' END, CASE WHEN (type = 'jpeg' AND NOT contains(h, 'FFD9')) OR (type = 'png' AND NOT contains(h, '49454E44')) OR (type = 'gif' AND NOT regexp_matches(h, '^(..)*3B')) OR (type = 'pdf' AND NOT contains(h, '2525454F46')) THEN '2truncated' END, CASE WHEN broken_container THEN '2broken-container' END, CASE WHEN decode_failed THEN '2decode-failed' END,
CASE WHEN code THEN '3runs-code' END, CASE WHEN quarantined THEN '3quarantine' END, CASE WHEN family = 'archive' OR type IN ('jar', 'xar') THEN '3archive' END, CASE WHEN type IN ('svg', 'html') THEN '3active-content' END] AS codes FROM g), k AS (SELECT *, list_filter(codes, lambda x: x IS NOT NULL) AS found FROM c)
SELECT doc_id, family, list_aggregate(list_transform(found, lambda x: x[2:]), 'string_agg', ',') AS codes, CASE WHEN len(list_filter(found, lambda x: x[1] < '3')) > 0 THEN 'anomalies' WHEN fits THEN 'match' ELSE 'plain' END AS summary FROM k""")
def finding_codes(spark, d):
    k = F.col("doc_id")
    rows = _sampled(spark, d).withColumns({n: k % m == 0 for n, m in (("executable_bit", 3), ("quarantined", 5), ("decode_failed", 7), ("media_blocked", 11), ("broken_container", 13))})
    found = X.assess(rows)
    return found.select("doc_id", kinds.family_of("type").alias("family"), F.nullif(F.array_join(F.transform("findings", lambda f: f["code"]), ","), F.lit("")).alias("codes"), X.summary().alias("summary"))


_W, _H = "(doc_id * 37 % 40000)", "(doc_id * 91 % 30000)"


@query(f"SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL WHEN doc_id % 6 = 3 THEN {_W} % 16384 + 1 WHEN doc_id % 6 = 1 THEN {_W} % 65536 ELSE {_W} END::BIGINT AS w, CASE WHEN doc_id % 6 = 5 THEN NULL WHEN doc_id % 6 = 3 THEN {_H} % 16384 + 1 ELSE {_H} END::BIGINT AS h FROM documents")
def header_sizes(spark, d):
    k = F.col("doc_id")
    w, h = k * 37 % 40000, k * 91 % 30000
    be = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    le = lambda x, n: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)])
    bits = (w % 16384).bitwiseOR(F.shiftleft(h % 16384, 14))
    made = (
        F.when(k % 6 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4))).when(k % 6 == 1, F.concat(F.lit("474946383961"), le(w, 2), le(h, 2))).when(k % 6 == 2, F.concat(F.lit("424D" + "00" * 16), le(w, 4), le(F.when(k % 4 == 0, (F.lit(1 << 32) - h) % (1 << 32)).otherwise(h), 4)))
        .when(k % 6 == 3, F.concat(F.lit("5249464600000000574542505650384C000000002F"), le(bits, 4))).when(k % 6 == 4, F.concat(F.lit("FFD8FFE000044A46FFFFC4000261FFC0001108".replace("C4000261", "C4000361")), be(h, 2), be(w, 2), F.lit("00" * 9))).otherwise(F.lit("68656C6C6F"))
    )
    kind = F.element_at(F.array(*map(F.lit, ("png", "gif", "bmp", "webp", "jpeg", "text"))), (k % 6 + 1).cast("int"))
    size = X.dimensions(F.unhex(made), kind)
    return table(spark, d, "documents").withColumn("d", size).select("doc_id", F.col("d.w").alias("w"), F.col("d.h").alias("h"))
