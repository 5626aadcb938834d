"""Queries over reference datasets: stand-in files are written from the tables, and read as the datasets are.

The files lie in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.views import plain, view
from loomgraph.session import checkpoint_folder
from loomgraph.sources import listed as N
from loomgraph.sources import readers as R
from loomgraph.sources import standard as S
from loomgraph.sources.robust import read_robust

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/sources-{uuid.uuid4().hex}/{name}"


def _written(df: DataFrame, name: str, fmt: str = "csv", **options: str) -> str:
    at = _path(df.sparkSession, name)
    df.write.format(fmt).options(**({"header": "true", "escape": '"'} if fmt == "csv" else {}) | options).save(at)
    return at


def _part(spark, d, *exprs: str) -> DataFrame:
    return _table(spark, d, "part").selectExpr(*exprs)


_CTD = "SELECT 'Chem ' || p_partkey AS chemical_name, 'D' || p_partkey AS chemical_id, p_name AS gene_symbol, CAST(p_size AS VARCHAR) AS gene_id, CASE WHEN p_partkey % 3 <> 0 THEN 'protein|mRNA' END AS gene_forms, p_brand || ', \"x\"' AS interaction_actions FROM part"


@query(_CTD)
def src_ctd_interactions(spark, d):
    raw = _part(spark, d, "'Chem ' || p_partkey AS ChemicalName", "'D' || p_partkey AS ChemicalID", "'y' AS Unlisted", "p_name AS GeneSymbol", "p_size AS GeneID", "CASE WHEN p_partkey % 3 <> 0 THEN 'protein|mRNA' END AS GeneForms", "p_brand || ', \"x\"' AS InteractionActions")
    data = S.DATASETS["ctd__chem_gene_ixn"]
    return S.read_dataset(spark, _written(raw, "CTD_chem_gene_ixns.csv"), S.Dataset(data.columns, options=data.options | {"escape": '"'}))


@query("SELECT p_name AS gene_symbol, p_brand AS gene_alias, p_type AS gene_description, CAST(p_partkey AS VARCHAR) AS entrez_id FROM part")
def src_hall_longevity(spark, d):
    raw = _part(spark, d, "p_name AS Symbol", "p_brand AS Alias", "p_type AS Description", "p_partkey AS Gene_ID")
    return S.read_dataset(spark, _written(raw, "hall.csv"), S.DATASETS["hall__longevity_map"])


@query("SELECT 'MI' || p_partkey AS mirbase_accession, p_name AS mir_id, CASE WHEN p_size > 25 THEN 'UNCHANGED' END AS status FROM part")
def src_mirbase(spark, d):
    return S.read_dataset(spark, _written(_part(spark, d, "'MI' || p_partkey AS Accession", "p_name AS ID", "CASE WHEN p_size > 25 THEN 'UNCHANGED' END AS Status"), "miRNA.csv"), S.DATASETS["mirbase__mirbase"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS hagr_id, p_name AS gene_symbol, '基因 ' || p_brand AS common_name FROM part")
def src_hagr_genes(spark, d):
    # each character of the two is one byte of its GBK form
    raw = _part(spark, d, "p_partkey AS `HAGR ID`", "p_name AS GeneSymbol", f"'{'基因'.encode('gbk').decode('latin-1')} ' || p_brand AS `common-name`")
    return S.read_dataset(spark, _written(raw, "hagr.csv", sep=";", encoding="ISO-8859-1"), S.DATASETS["hagr__genes"])


@query("SELECT 'HGNC:' || p_partkey AS hgnc_id, p_name AS symbol, p_type || '|' || p_brand AS alias_symbol FROM part")
def src_hgnc_genes(spark, d):
    return S.read_dataset(spark, _written(_part(spark, d, "'HGNC:' || p_partkey AS hgnc_id", "p_name AS symbol", "p_type || '|' || p_brand AS alias_symbol"), "hgnc.tsv", sep="\t"), S.DATASETS["hgnc__genes"])


@query("SELECT DISTINCT 'URS' || l_partkey AS urs_acc, l_suppkey || '_x' AS ncbi_taxid, 'GO:' || l_linenumber AS go_id, 'RF' || CAST(l_suppkey % 5 AS INT) AS rfam_id FROM lineitem")
def src_rnacentral(spark, d):
    raw = _table(spark, d, "lineitem").selectExpr("'URS' || l_partkey || '_' || l_suppkey || '_x' AS a", "'GO:' || l_linenumber AS b", "'RF' || CAST(l_suppkey % 5 AS INT) AS c")
    return S.rnacentral(S.read_dataset(spark, _written(raw, "rfam.tsv", sep="\t", header="false"), S.DATASETS["rnacentral__rfam"]))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS entrez_id, upper(p_name) AS gene_symbol_parsed, p_type AS gene_description, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS chromosome FROM part")
def src_bracket_info(spark, d):
    info = F.expr("' ' || p_partkey || ' [Gene Symbol: ' || p_name || '] [Description:  ' || p_type || ' ] [Chromosome: ' || CASE WHEN p_size > 25 THEN CAST(p_size AS STRING) ELSE '' END || ']'")
    return _table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in S.bracket_columns(info).items() if n in ("entrez_id", "gene_symbol_parsed", "gene_description", "chromosome")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 'G' || p_partkey END AS gene_symbol, CASE WHEN p_partkey % 4 > 0 THEN p_name || ', (II)' END AS gene_description, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) END AS ref_id,
CASE WHEN p_partkey % 3 > 0 THEN '2001' END AS article_year, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS article_title, CASE WHEN p_partkey % 3 > 0 THEN 'J Cell Biol' END AS journal_name, CASE WHEN p_partkey % 3 > 0 THEN '12.3:4-5' END AS journal_info, CASE WHEN p_partkey % 3 > 0 THEN '77' END AS pubmed_id FROM part""")
def src_gene_citation(spark, d):
    gene = F.expr("CASE WHEN p_partkey % 4 > 0 THEN ' g' || p_partkey || ' (' || p_name || ', (II)) ' ELSE p_name END")
    cited = F.expr("""CASE WHEN p_partkey % 3 > 0 THEN p_partkey || ': A B, C D (2001) "' || p_type || '" J Cell Biol. 12.3:4-5 (77)' ELSE p_type END""")
    ref = {n: c for n, c in S.citation(cited).items() if n != "article_authors"}
    return _table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in (S.gene_and_description(gene) | ref).items()))


@query("SELECT o_orderkey, o_custkey AS entity_index, coalesce(c.c_name, '') AS entity_name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey")
def src_index_names(spark, d):
    names = _table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("entity_index"), F.col("c_name").alias("entity_name"))
    return S.with_names(_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_index")), names)


def _documents(rows: DataFrame, before: str, after: str, between: str = "") -> DataFrame:
    """rows (value) as documents, one of each task: what comes before the first value, between two and after the last."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda x: pa.RecordBatch.from_arrays([x], names=["value"])
        yield lines(pa.array([before]))
        first = True
        for batch in batches:
            values = batch.column(0)
            if first and len(values):
                yield lines(values[:1])
                first, values = False, values[1:]
            yield lines(pc.binary_join_element_wise(between, values, "") if between else values)
        yield lines(pa.array([after]))

    return rows.select("value").mapInArrow(document, "value string")


def _xml(spark: SparkSession, d: str, record: str, name: str) -> str:
    """Documents of a record for each part."""
    return _written(_documents(_part(spark, d, record), "<Set>", "</Set>"), name, "text")


def _rrf(df: DataFrame, name: str, width: int, columns: dict[int, str]) -> str:
    """Pipe-delimited lines, each ended by a pipe."""
    cells = [F.coalesce(F.expr(columns[k]).cast("string"), F.lit("")) if k in columns else F.lit("") for k in range(width)]
    return _written(df.select(F.concat(F.concat_ws("|", *cells), F.lit("|")).alias("value")), name, "text")


def _conso(spark, d):
    line = _table(spark, d, "lineitem")
    conso = _rrf(line, "MRCONSO.RRF", 18, {0: "'C' || l_partkey", 1: "CASE WHEN l_suppkey % 7 = 0 THEN 'FRE' ELSE 'ENG' END", 11: "'MSH'", 12: "CASE l_linenumber WHEN 1 THEN 'PT' WHEN 2 THEN 'PF' WHEN 3 THEN 'PN' ELSE 'SY' END", 14: "' Name \"' || l_suppkey || ' '"})
    return S.read_rrf(spark, conso, {0: "cui", 1: "lat", 11: "sab", 12: "tty", 14: "str"})


def _umls(spark, d):
    line, part = _table(spark, d, "lineitem"), _table(spark, d, "part")
    sty = _rrf(part, "MRSTY.RRF", 6, {0: "'C' || p_partkey", 1: "'T' || p_size", 3: "p_type"})
    definition = _rrf(line.where("l_linenumber < 3"), "MRDEF.RRF", 8, {0: "'C' || l_partkey", 4: "CASE l_suppkey % 3 WHEN 0 THEN 'MSH' WHEN 1 THEN 'SNOMEDCT_US' ELSE 'NCI' END", 5: "'Definition ' || l_suppkey"})
    return S.umls_nodes(_conso(spark, d), S.read_rrf(spark, sty, {0: "cui", 1: "tui", 3: "semantic_type"}), S.read_rrf(spark, definition, {0: "cui", 4: "sab", 5: "def"}))


_UMLS = """WITH n AS (SELECT 'C' || l_partkey AS cui, CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS r, 'Name "' || l_suppkey AS s FROM lineitem WHERE l_suppkey % 7 <> 0),
b AS (SELECT cui, s FROM (SELECT cui, s, row_number() OVER (PARTITION BY cui ORDER BY r, s) AS k FROM n WHERE r IS NOT NULL) x WHERE k = 1),
sy AS (SELECT cui, string_agg(DISTINCT s, ';' ORDER BY s) AS syn FROM n GROUP BY cui),
df AS (SELECT cui, t FROM (SELECT 'C' || l_partkey AS cui, 'Definition ' || l_suppkey AS t, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey % 3, 'Definition ' || l_suppkey) AS k FROM lineitem WHERE l_linenumber < 3) x WHERE k = 1),
nodes AS (SELECT b.cui AS entity_ref_id, b.s AS entity_name, sy.syn AS entity_synonyms, 'T' || p_size AS tui, p_type AS semantic_type, df.t AS entity_definition, 'UMLS' AS sab, 'umls' AS src_db
FROM b JOIN sy ON b.cui = sy.cui LEFT JOIN part ON b.cui = 'C' || p_partkey LEFT JOIN df ON df.cui = b.cui)"""


@query(f"{_UMLS} SELECT * FROM nodes")
def src_umls_nodes(spark, d):
    return _umls(spark, d)


@query(f"""{_UMLS}, r AS (SELECT DISTINCT 'C' || l_partkey AS a, 'C' || l_suppkey AS b, CASE WHEN l_linenumber > 2 THEN 'isa' ELSE 'RB' END AS rel_type FROM lineitem)
SELECT a AS source_entity_ref_id, b AS target_entity_ref_id, rel_type, 'MSH' AS sab, x.entity_name AS source_entity_name, y.entity_name AS target_entity_name, 'both' AS direction, 'umls' AS src_db
FROM r LEFT JOIN nodes x ON a = x.entity_ref_id LEFT JOIN nodes y ON b = y.entity_ref_id""")
def src_umls_relations(spark, d):
    rel = _rrf(_table(spark, d, "lineitem"), "MRREL.RRF", 16, {0: "'C' || l_partkey", 3: "'RB'", 4: "'C' || l_suppkey", 7: "CASE WHEN l_linenumber > 2 THEN 'isa' END", 10: "'MSH'"})
    return S.umls_relations(S.read_rrf(spark, rel, {0: "cui1", 3: "rel", 4: "cui2", 7: "rela", 10: "sab"}), S.umls_names(_conso(spark, d)))


def _graph(spark, d):
    nodes = _table(spark, d, "customer").selectExpr("c_custkey AS identifier", "CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name", "'Gene' AS kind", "named_struct('source', c_mktsegment, 'url', CAST(NULL AS STRING)) AS data")
    edges = _table(spark, d, "orders").selectExpr("o_orderkey AS k", "array('Gene', CAST(o_custkey AS STRING)) AS source_id", "array('Order', CAST(-o_orderkey AS STRING)) AS target_id", "o_orderpriority AS kind", "CASE WHEN o_orderkey % 2 = 0 THEN 'forward' END AS direction", "named_struct('unbiased', o_orderkey % 3 = 0) AS data")
    line = lambda df: df.select(F.to_json(F.struct(*[c for c in df.columns if c != "k"])).alias("value"))
    documents = _documents(line(nodes), '{"nodes": [', '], "edges": []}', ", ").union(_documents(line(edges), '{"nodes": [], "edges": [', "]}", ", "))
    return S.read_graph_json(spark, _written(documents, "graph.json", "text"))


@query("SELECT CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE '' END AS entity_name, 'Gene' AS entity_type, CAST(c_custkey AS VARCHAR) AS entity_ref_id, c_mktsegment AS data_source, '' AS data_source_url, 'hetionet' AS src_db FROM customer")
def src_graph_nodes(spark, d):
    return _graph(spark, d)[0]


@query("""SELECT 'Gene' AS source_entity_type, CAST(o_custkey AS VARCHAR) AS source_entity_ref_id, CASE WHEN o_custkey % 4 > 0 THEN c_name ELSE 'Gene:' || o_custkey END AS source_entity_name, 'Order' AS target_entity_type, CAST(-o_orderkey AS VARCHAR) AS target_entity_ref_id,
'Order:' || CAST(-o_orderkey AS VARCHAR) AS target_entity_name, o_orderpriority AS rel_type, CASE WHEN o_orderkey % 2 = 0 THEN 'forward' ELSE 'both' END AS direction, '' AS data_source, CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END AS unbiased, 'hetionet' AS src_db FROM orders JOIN customer ON o_custkey = c_custkey""")
def src_graph_edges(spark, d):
    return _graph(spark, d)[1]


def _mesh(spark, d):
    relation = "'<ConceptRelation RelationName=\"NRW\"><Concept1UI>M' || p_partkey || '</Concept1UI><Concept2UI>M' || p_size || '</Concept2UI></ConceptRelation>'"
    action = "'<PharmacologicalAction><DescriptorReferredTo><DescriptorUI>D' || p_size || '</DescriptorUI><DescriptorName><String>' || p_brand || '</String></DescriptorName></DescriptorReferredTo></PharmacologicalAction>'"
    record = f"""'<DescriptorRecord><DescriptorUI>D' || p_partkey || '</DescriptorUI><DescriptorName><String>' || p_name || '</String></DescriptorName><ConceptList><Concept><ConceptRelationList>' || {relation} || '</ConceptRelationList></Concept><Concept/></ConceptList>'
|| CASE WHEN p_size > 25 THEN '<PharmacologicalActionList>' || {action} || {action} || '</PharmacologicalActionList>' ELSE '' END || '</DescriptorRecord>' AS value"""
    return S.read_mesh_descriptors(spark, _xml(spark, d, record, "desc.xml"))


@query("SELECT 'D' || p_partkey AS mesh_id, p_name AS entity_name, 'desc' AS category, 'mesh' AS src_db FROM part")
def src_mesh_descriptors(spark, d):
    return _mesh(spark, d)[0]


@query("SELECT 'D' || p_partkey AS descriptor_ui, 'M' || p_partkey AS concept1_ui, 'M' || p_size AS concept2_ui, 'NRW' AS relation_name FROM part")
def src_mesh_concepts(spark, d):
    return _mesh(spark, d)[1]


@query("SELECT 'D' || p_partkey AS descriptor_ui, 'D' || p_size AS pa_ui, p_brand AS pa_name FROM part WHERE p_size > 25")
def src_mesh_actions(spark, d):
    return _mesh(spark, d)[2]


@query("SELECT 'P' || p_partkey AS accession, p_brand AS entry_name, p_name AS protein_name, CASE WHEN p_size > 25 THEN 'S' || p_size END AS short_name, CASE WHEN p_partkey % 3 > 0 THEN 'G' || p_partkey END AS gene_symbol, 'Homo sapiens' AS organism FROM part")
def src_uniprot(spark, d):
    entry = """'<entry><accession>P' || p_partkey || '</accession><accession>Q0</accession><name>' || p_brand || '</name><protein><recommendedName><fullName>' || p_name || '</fullName>' || CASE WHEN p_size > 25 THEN '<shortName>S' || p_size || '</shortName>' ELSE '' END
|| '</recommendedName></protein>' || CASE WHEN p_partkey % 3 > 0 THEN '<gene><name type="synonym">z</name><name type="primary">G' || p_partkey || '</name></gene>' ELSE '' END || '<organism><name type="common">Human</name><name type="scientific">Homo sapiens</name></organism></entry>' AS value"""
    return S.read_uniprot(spark, _xml(spark, d, entry, "sprot.xml"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part) SELECT 'A' || k AS icd10_code, n AS description, 'X Chapter' AS chapter, 'Section' AS section, '["own", "deep"]' AS note FROM p
UNION ALL SELECT 'A' || k || '.' || l, n || ' ' || l, 'X Chapter', 'Section', CASE l WHEN 3 THEN '["deep"]' ELSE '[]' END FROM p, (VALUES (1), (2), (3)) v(l)
UNION ALL SELECT 'A' || k || '.30', 'last', 'X Chapter', 'Section', '["deep"]' FROM p""")
def src_icd10(spark, d):
    child = lambda k: f"'<diag><name>A' || p_partkey || '.{k}</name><desc>' || p_name || ' {k}</desc></diag>'"
    third = "'<diag><name>A' || p_partkey || '.3</name><desc>' || p_name || ' 3</desc><diag><name>A' || p_partkey || '.30</name><desc>last</desc><includes><note>deep</note></includes></diag></diag>'"
    chapter = f"'<chapter><name>X</name><desc>Chapter</desc><sectionIndex><sectionRef>z</sectionRef></sectionIndex><section><desc>Section</desc><diag><name>A' || p_partkey || '</name><desc>' || p_name || '</desc><includes><note> own </note></includes>' || {child(1)} || {child(2)} || {third} || '</diag></section></chapter>' AS value"
    return S.read_icd10(spark, _written(_part(spark, d, chapter), "tabular.xml", "text"))


def _letters(spark, d, body: str, name: str) -> str:
    """Documents with a letter for each part."""
    return _xml(spark, d, f"'<letter><title>L</title><mainTerm>' || {body} || '</mainTerm></letter>' AS value", name)


@query("""SELECT p_name AS index_term, 0 AS index_level, 'A' || p_partkey AS icd10_code FROM part UNION SELECT p_name || ' with', 1, 'B' || p_partkey FROM part
UNION SELECT p_name || ' with big', 2, 'C' || p_partkey FROM part WHERE p_size > 25 UNION SELECT p_name || ' with', 2, 'D' || p_partkey FROM part WHERE p_size <= 25""")
def src_icd10_index(spark, d):
    deep = "CASE WHEN p_size > 25 THEN '<term level=\"2\"><title> big </title><code>C' || p_partkey || '</code></term>' ELSE '<term level=\"2\"><code> D' || p_partkey || '</code><code> </code></term>' END"
    body = f"'<title>' || p_name || ' </title><code>A' || p_partkey || '</code><term level=\"1\"><title>with<nemod>(x)</nemod></title><code>B' || p_partkey || '</code><code>B' || p_partkey || '</code>' || {deep} || '</term>'"
    return S.read_icd10_terms(spark, _letters(spark, d, body, "index.xml"), "index")


@query("""SELECT p_name AS index_term, 0 AS index_level, 'benign' AS neoplasm_kind, 'D' || p_partkey AS icd10_code FROM part UNION SELECT p_name || ' skin', 1, CASE WHEN p_size > 25 THEN 'malignant_primary' ELSE '' END, 'C' || p_partkey FROM part""")
def src_icd10_neoplasm(spark, d):
    body = "'<title>' || p_name || '</title><cell col=\"5\"> D' || p_partkey || '</cell><cell col=\"6\">--</cell><cell col=\"7\"/><term><title>skin</title><cell col=\"' || CASE WHEN p_size > 25 THEN 2 ELSE 9 END || '\">C' || p_partkey || '</cell></term>'"
    return S.read_icd10_terms(spark, _letters(spark, d, body, "neoplasm.xml"), "neoplasm")


@query("""SELECT p_name || ' (salt)' AS substance, 'assault' AS drug_intent, 'T' || p_partkey AS icd10_code, 1 AS index_level FROM part UNION SELECT 'lotion', 'underdosing', 'U' || p_partkey, 2 FROM part""")
def src_icd10_drugs(spark, d):
    body = "'<title>' || p_name || ' <nemod>(salt)</nemod></title><cell col=\"4\">T' || p_partkey || '</cell><cell col=\"2\">-</cell><term><title>lotion</title><cell col=\"7\">U' || p_partkey || '</cell></term><term><title> </title><cell col=\"7\">V</cell></term>'"
    return S.read_icd10_terms(spark, _letters(spark, d, body, "drug.xml"), "drug")


@query("SELECT 'Q' || p_partkey AS mesh_id, p_name AS entity_name, 'qual' AS category, 'mesh' AS src_db FROM part UNION ALL SELECT 'C' || p_partkey, p_brand, 'supp', 'mesh' FROM part")
def src_mesh_names(spark, d):
    record = lambda kind, ui, name, k, n: f"'<{kind}Record><{ui}>{k}' || p_partkey || '</{ui}><{name}><String>' || {n} || '</String></{name}></{kind}Record>' AS value"
    qualifiers = _xml(spark, d, record("Qualifier", "QualifierUI", "QualifierName", "Q", "p_name"), "qual.xml")
    supplements = _xml(spark, d, record("Supplemental", "SupplementalRecordUI", "SupplementalRecordName", "C", "p_brand"), "supp.xml")
    tables = S.standard_tables(spark, {"mesh__qualifiers": qualifiers, "mesh__supplements": supplements})
    return tables["mesh__qualifiers"].unionByName(tables["mesh__supplements"])


_SUBSTANCES = "'<PharmacologicalAction><DescriptorReferredTo><DescriptorUI>D' || p_size || '</DescriptorUI><DescriptorName><String>Action ' || p_size || '</String></DescriptorName></DescriptorReferredTo><PharmacologicalActionSubstanceList>' || CASE WHEN p_partkey % 3 > 0 THEN '<Substance><RecordUI>C' || p_partkey || '</RecordUI><RecordName><String>' || p_name || '</String></RecordName></Substance><Substance><RecordUI>C0</RecordUI></Substance>' ELSE '' END || '</PharmacologicalActionSubstanceList></PharmacologicalAction>' AS value"


@query("SELECT DISTINCT 'D' || p_size AS mesh_id, 'Action ' || p_size AS entity_name, 'pa' AS category, 'mesh' AS src_db FROM part")
def src_mesh_action_names(spark, d):
    return S.standard_tables(spark, {"mesh__actions": _xml(spark, d, _SUBSTANCES, "pa.xml")})["mesh__actions"]


@query("SELECT 'D' || p_size AS descriptor_ui, 'C' || p_partkey AS substance_ui, p_name AS substance_name FROM part WHERE p_partkey % 3 > 0 UNION SELECT 'D' || p_size, 'C0', NULL FROM part WHERE p_partkey % 3 > 0")
def src_mesh_substances(spark, d):
    return S.standard_tables(spark, {"mesh__substances": _xml(spark, d, _SUBSTANCES, "pa.xml")})["mesh__substances"]


@query("SELECT '9606' AS tax_id, CAST(p_partkey AS VARCHAR) AS ncbi_gene_id, p_name AS gene_symbol, 'a \"b|' || p_brand AS gene_alias, p_type AS gene_description FROM part")
def src_ncbi_genes(spark, d):
    raw = _part(spark, d, "'9606' AS `#tax_id`", "p_partkey AS GeneID", "p_name AS Symbol", "'a \"b|' || p_brand AS Synonyms", "'-' AS unlisted", "p_type AS description")
    return S.standard_tables(spark, {"ncbi__gene": _written(raw, "gene_info.tsv", sep="\t", quote="")})["ncbi__gene"]


@query("""SELECT o_orderpriority AS relation_type, CAST(c_custkey AS VARCHAR) AS source_entity_index, c_name AS source_entity_name, CAST(o_orderkey AS VARCHAR) AS target_entity_index, 'drug' AS target_entity_type FROM orders JOIN customer ON o_custkey = c_custkey""")
def src_primekg_relations(spark, d):
    raw = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = raw.selectExpr("o_orderpriority AS relation", "c_custkey AS x_index", "c_name AS x_name", "o_orderkey AS y_index", "'drug' AS y_type")
    return S.standard_tables(spark, {"primekg__relations": _written(raw, "kg.csv"), "unread": "/nowhere"}, ["primekg__relations"])["primekg__relations"]


_EXTRA = "'{\"brand\": \"' || p_brand || '\"' || CASE WHEN p_size > 25 THEN ', \"sizes\": [\"' || p_size || '\", \"big\"]' ELSE '' END || '}'"


@query(f"""SELECT p_name AS entity_name, p_type AS entity_type, 'k' || p_partkey AS primary_info, {_EXTRA} AS extra_json, 'parts.csv' AS source_file FROM part WHERE p_partkey % 5 > 0
UNION ALL SELECT c_name, 'Customer', '', '{{}}', 'customers.tsv' FROM customer""")
def collect_nodes(spark, d):
    parts = _part(spark, d, "CASE WHEN p_partkey % 5 > 0 THEN ' ' || p_name ELSE '  ' END AS name", "p_type AS kind", "'k' || p_partkey AS code", "p_brand AS brand", "CASE WHEN p_size > 25 THEN p_size || ' ;|big' END AS sizes")
    customers = _table(spark, d, "customer").selectExpr("c_name AS name")
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return R.collected(spark, [
        R.Source(_written(parts, "parts.csv", **keep), key="name", primary="code", kind_column="kind", extra={"brand": "brand", "sizes": "sizes"}, options=keep),
        R.Source(_written(customers, "customers.tsv", sep="\t"), "tsv", key="name", kind="Customer"),
    ])


@query(f"SELECT source_entity_name AS source_name, target_entity_name AS target_name, relation_type, 'rel.csv' AS source_file FROM ({plain('rel')}) v UNION ALL SELECT n_name, r_name, 'in', 'nations.csv' FROM nation JOIN region ON n_regionkey = r_regionkey")
def collect_relations(spark, d):
    nations = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    rel = view(spark, d, "rel").select("source_entity_name", "target_entity_name", "relation_type")
    return R.collected(spark, [
        R.Source(_written(rel, "rel.csv"), source="source_entity_name", target="target_entity_name", kind_column="relation_type"), R.Source(_written(nations, "nations.csv"), source="n_name", target="r_name", kind="in"),
    ], R.relations)


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n FROM orders GROUP BY 1")
def src_yearly_files(spark, d):
    """Files of a year each, read back by a glob; the year comes from their names."""
    orders = _table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    at = _path(spark, "yearly")
    orders.withColumn("tag", F.concat(F.lit("ARTICLES_Y"), "y")).write.partitionBy("tag").option("header", "true").csv(at)
    rows = spark.read.option("header", "true").option("basePath", at).csv(f"{at}/tag=ARTICLES_Y*")
    return rows.groupBy(F.regexp_extract("tag", r"_Y(\d{4})", 1).alias("year")).agg(F.count("*").alias("n"))


_ROBUST = "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '衰老, ' ELSE '' END || p_name AS name, p_type AS kind FROM part"


def _robust(spark, d):
    """A folder of files of two makes: GB18030 with tabs, UTF-8 with commas; some lines lack a field."""
    at = _path(spark, "mixed")
    part = _table(spark, d, "part").selectExpr("p_partkey AS k", "p_name AS name", "p_type AS kind")
    lacks = lambda sep: F.when(F.col("k") % 7 == 0, F.concat_ws(sep, F.col("k").cast("string"), "name"))
    tabs = part.where("k % 2 = 0").select(lacks("\t").alias("short"), F.concat_ws("\t", F.col("k").cast("string"), F.concat(F.lit("衰老, ".encode("gb18030").decode("latin-1")), "name"), "kind").alias("full"))
    commas = part.where("k % 2 = 1").select(lacks(",").alias("short"), F.concat_ws(",", F.col("k").cast("string"), F.concat(F.lit('"'), "name", F.lit('"')), "kind").alias("full"))
    for rows, sep, encoding in ((tabs, "\t", "ISO-8859-1"), (commas, ",", "UTF-8")):
        # each part file has its own header, as files of a folder have
        rows.select(F.coalesce("short", "full").alias(sep.join(("id", "name", "kind")))).write.mode("append").option("header", "true").option("sep", "\x01").option("quote", "").option("encoding", encoding).csv(at)
    return read_robust(spark, at)


@query(f"SELECT CAST(k AS VARCHAR) AS id, name, kind FROM ({_ROBUST}) x WHERE k % 7 <> 0")
def src_mixed_files(spark, d):
    """The lines of files of different charsets and delimiters."""
    return _robust(spark, d)[0].select("id", "name", "kind")


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 7 = 0")
def src_mixed_malformed(spark, d):
    """The number of lines that lack a field."""
    return _robust(spark, d)[1].agg(F.count("*").alias("n"))


def _listed(spark, d, table: str, sep: str, **values: str) -> DataFrame:
    """A stand-in of a table's files, read by its list of columns; a column that isn't in the list is in them too."""
    cells = [f"CAST({v} AS STRING) AS `{c}`" for c, v in values.items()]
    return N.read_listed(spark, _written(_part(spark, d, *cells, "'x' AS unlisted"), f"{table}.txt", sep=sep), table)[0]


@query("SELECT 'Chem ' || p_partkey AS chemical_name, 'D' || p_partkey AS chemical_id, p_name AS gene_symbol, 'protein|mRNA' AS gene_form, p_brand || '^x' AS interaction_action, p_size || '|7' AS pubmed_id FROM part")
def src_ageanno_drugs(spark, d):
    """A table of many-valued fields; their values stay joined as they are published."""
    return _listed(spark, d, "ageanno__related_drugs", "\t", ChemicalName="'Chem ' || p_partkey", ChemicalID="'D' || p_partkey", GeneSymbol="p_name", GeneForms="'protein|mRNA'", InteractionActions="p_brand || '^x'", PubMedIDs="p_size || '|7'")


@query("SELECT p_name AS gene_symbol, p_type || ', or so' AS comment, CASE WHEN p_size > 25 THEN p_brand END AS protein_activity, 'G' || p_partkey AS regulated_gene, '10.1/' || p_partkey AS article_doi, CAST(p_partkey AS VARCHAR) AS pubmed_id FROM part")
def src_opengenes_regulation(spark, d):
    """A table that lacks one of its listed columns."""
    return _listed(spark, d, "opengenes__gene_regulation", "\t", hgnc="p_name", comment="p_type || ', or so'", protein_activity="CASE WHEN p_size > 25 THEN p_brand END", regulated_gene="'G' || p_partkey", doi="'10.1/' || p_partkey", pmid="p_partkey")


@query("""SELECT disease_name, disease_id, external_disease_ids, synonym FROM (SELECT p_name || ', "' || p_brand || '"' AS disease_name, 'MESH:D' || p_partkey AS disease_id, 'DO:' || p_size AS external_disease_ids, unnest(['a ' || p_type, 'b']) AS synonym FROM part) x""")
def src_ctd_diseases(spark, d):
    """A table with quoted fields, its synonyms taken apart."""
    rows = _listed(spark, d, "ctd__diseases", ",", DiseaseName="p_name || ', \"' || p_brand || '\"'", DiseaseID="'MESH:D' || p_partkey", AltDiseaseIDs="'DO:' || p_size", Synonyms="'a ' || p_type || '|b'")
    return rows.select("disease_name", "disease_id", "external_disease_ids", F.explode(F.split("synonyms", r"\|")).alias("synonym"))
