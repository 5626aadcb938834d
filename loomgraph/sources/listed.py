"""Reference datasets by the list of their published columns: what isn't renamed gets its snake case.

A table here is a list of column names; `RENAMED` says for each dataset, and `OWN` for single tables, which of them have a standard
name that the rule doesn't give. Columns that a file lacks are passed over, those that aren't listed are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.robust import read_robust
from loomgraph.sources.standard import snake

# The columns of the datasets' tables as they are published, `|` between them.
TABLES = {
    "ageanno__related_diseases": "geneId|geneSymbol|DSI|DPI|diseaseId|score|EI|YearInitial|YearFinal|number of pmid|source",
    "ageanno__related_drugs": "ChemicalName|ChemicalID|GeneSymbol|GeneForms|InteractionActions|PubMedIDs",
    "ageanno__aging_related_dar": "Tissue|cell_type|geneId|SYMBOL|Category|change|CHR|start|end|Log2FC|Pval|annotation",
    "ageanno__co_accessibility": "Tissue|Cell_type|Category|Change|Chromosome|Start|End|Annotation|Gene.ID|Symbol|Correlated_Start|Correlated_End|Correlated_Annotation|Correlated_Gene.ID|Correlated_Symbol|Correlation",
    "ageanno__motif_tf": "Tissue|cell_type|TF|Category|change|mid_Variability|old_Variability|Pval",
    "ageanno__scatac_marker": "Tissue|group_name|seqnames|start|end|strand|name",
    "ageanno__aging_related_deg": "Tissue|cell_type|group|gene|change|p_val|avg_log2FC|pct.1|pct.2|p_val_adj|isTissuespecific|isCellTypespecific",
    "ageanno__cell_cell_communication": "Tissue|group|interacting_pair|partner_a|partner_b|gene_a|gene_b|secreted|receptor_a|receptor_b|annotation_strategy|is_integrin|cell.type_a|cell.type_b|exp_means|p.value",
    "ageanno__gene_variation_coefficient": "Tissue|group|cell_type|Gene|Result",
    "ageanno__pathways": "Tissue|cell_type|group|UpOrDown|Unnamed: 4|ID|Description|GeneRatio|BgRatio|pvalue|p.adjust|qvalue|geneID|Count",
    "ageanno__scrna_marker": "Tissue|Cell type|Marker gene",
    "ageanno__tf_regulation": "Tissue|group|cell_type|TF|rss_value|image_URL|Targets_number|Targets",
    "opengenes__longevity_gene": "Gene symbol|Gene name|Longevity polymorphisms|Organism, ortholog and number of studies/entries* for data on increased lifespan|Effect on gene function, increased lifespan",
    "opengenes__gene_aging_mechanisms": "hgnc|hallmarks_of_aging",
    "opengenes__gene_confidence_level": "hgnc|confidence_level",
    "opengenes__gene_criteria": "hgnc|criteria",
    "opengenes__gene_disease": "hgnc|diseases",
    "opengenes__gene_evolution": "hgnc|gene_origin|gene_family_origin|conservative_in",
    "opengenes__gene_regulation": "hgnc|comment|protein_activity|regulated_gene|regulation_type|doi|pmid",
    "opengenes__age_related_processes": "hgnc|comment|intervention|model_organism|line|intervention_deteriorates|intervention_improves|intervention_result|process|age|genotype|sex|doi|pmid",
    "opengenes__age_related_changes": "hgnc|model_organism|line|sex|change_percentage|sample|age_of_control_min|age_of_control_mean|age_of_control_max|age_of_experiment_min|age_of_experiment_mean|age_of_experiment_max|age_unit|change_type|control_cohort_size|experiment_cohort_size|statistical_method|p_value|expression_evaluation_by|measurement_method|comment|doi|pmid",
    "opengenes__association_with_longevity": "hgnc|polymorphism_type|polymorphism_id|nucleotide_substitution|amino_acid_substitution|polymorphism_other|effect|association_type|significance|p_value|change_type|control_cohort_size|experiment_cohort_size|control_lifespan_min|control_lifespan_mean|control_lifespan_max|experiment_lifespan_min|experiment_lifespan_mean|experiment_lifespan_max|ethnicity|associated_allele|non-associated_allele|allelic_frequency_controls|allelic_frequency_experiment|sex|study_type|comment|doi|pmid",
    "opengenes__lifespan_change": "hgnc|model_organism|line|sex|effect_on_lifespan|control_cohort_size|experiment_cohort_size|quantity_of_animals_in_cage_or_container|containment_t_celsius_from|containment_t_celsius_to|diet|target_gene_expression_change|control_lifespan_min|control_lifespan_mean|control_lifespan_median|control_lifespan_max|experiment_lifespan_min|experiment_lifespan_mean|experiment_lifespan_median|experiment_lifespan_max|lifespan_time_unit|lifespan_%_change_min|lifespan_%_change_mean|lifespan_%_change_median|lifespan_%_change_max|significance_min|significance_mean|significance_median|significance_max|intervention_deteriorates|intervention_improves|main_effect_on_lifespan|intervention_way|intervention_method|genotype|tissue|promoter_or_driver|induction_by_drug_withdrawal|drug|treatment_start|treatment_end|doi|pmid",
    "ctd__anatomy": "AnatomyName|AnatomyID|Definition|AltAnatomyIDs|ParentIDs|TreeNumbers|ParentTreeNumbers|Synonyms|ExternalSynonyms",
    "ctd__chem_gene_ixn_types": "TypeName|Code|Description|ParentCode",
    "ctd__chem_go_enriched": "ChemicalName|ChemicalID|CasRN|Ontology|GOTermName|GOTermID|HighestGOLevel|PValue|CorrectedPValue|TargetMatchQty|TargetTotalQty|BackgroundMatchQty|BackgroundTotalQty",
    "ctd__chem_pathways_enriched": "ChemicalName|ChemicalID|CasRN|PathwayName|PathwayID|PValue|CorrectedPValue|TargetMatchQty|TargetTotalQty|BackgroundMatchQty|BackgroundTotalQty",
    "ctd__chemicals": "ChemicalName|ChemicalID|CasRN|Definition|ParentIDs|TreeNumbers|ParentTreeNumbers|Synonyms",
    "ctd__chemicals_diseases": "ChemicalName|ChemicalID|CasRN|DiseaseName|DiseaseID|InferenceGeneSymbol|InferenceScore|OmimIDs|PubMedIDs",
    "ctd__curated_genes_diseases": "GeneSymbol|GeneID|DiseaseName|DiseaseID|DirectEvidence|OmimIDs|PubMedIDs",
    "ctd__diseases": "DiseaseName|DiseaseID|AltDiseaseIDs|Definition|ParentIDs|TreeNumbers|ParentTreeNumbers|Synonyms|SlimMappings",
    "ctd__diseases_pathways": "DiseaseName|DiseaseID|PathwayName|PathwayID|InferenceGeneSymbol",
    "ctd__exposure_studies": "reference|studyfactors|exposurestressors|receptors|studycountries|mediums|exposuremarkers|diseases|phenotypes|authorsummary",
    "ctd__genes": "GeneSymbol|GeneName|GeneID|AltGeneIDs|Synonyms|BioGRIDIDs|PharmGKBIDs|UniProtIDs",
    "ctd__genes_diseases": "GeneSymbol|GeneID|DiseaseName|DiseaseID|DirectEvidence|InferenceChemicalName|InferenceScore|OmimIDs|PubMedIDs",
    "ctd__genes_pathways": "GeneSymbol|GeneID|PathwayName|PathwayID",
    "ctd__pathways": "PathwayName|PathwayID",
    "ctd__pheno_term_ixns": "chemicalname|chemicalid|casrn|phenotypename|phenotypeid|comentionedterms|organism|organismid|interaction|interactionactions|anatomyterms|inferencegenesymbols|pubmedids",
    "ctd__phenotype_disease": "GOName|GOID|DiseaseName|DiseaseID|InferenceChemicalQty|InferenceChemicalNames|InferenceGeneQty|InferenceGeneSymbols",
}

# Standard names that the rule doesn't give; `patent_ids` and `uniport_ids` are spelled so in the contract.
RENAMED = {
    "ageanno": {
        "group": "category", "start": "chr_start_site", "end": "chr_end_site", "Start": "chr_start_site", "End": "chr_end_site", "Symbol": "gene_symbol", "SYMBOL": "gene_symbol", "gene": "gene_symbol", "Gene": "gene_symbol",
        "Correlated_Start": "correlated_chr_start_site", "Correlated_End": "correlated_chr_end_site", "gene_a": "gene_symbol_a", "gene_b": "gene_symbol_b", "Marker gene": "gene_symbol", "CHR": "chromosome", "seqnames": "chromosome", "TF": "transcription_factors",
        "Log2FC": "log2foldchange", "avg_log2FC": "average_log2foldchange", "Pval": "pvalue", "p_val": "pvalue", "p.value": "pvalue", "p_val_adj": "pvalue_adjusted", "p.adjust": "pvalue_adjusted", "exp_means": "expression_means",
        "mid_Variability": "mid_population_variability", "old_Variability": "old_population_variability", "pct.1": "pct_expr_group1", "pct.2": "pct_expr_group2", "isTissuespecific": "is_tissue_specific", "isCellTypespecific": "is_cell_type_specific",
        "DSI": "disease_specificity_index", "DPI": "disease_pleiotropy_index", "EI": "evidence_index", "score": "ageanno_score", "YearInitial": "pub_year_initial", "YearFinal": "pub_year_final",
        "GeneForms": "gene_form", "InteractionActions": "interaction_action", "PubMedIDs": "pubmed_id", "group_name": "cell_type", "strand": "chr_strand", "name": "gene_symbol", "Result": "variation_coefficient_result",
        "UpOrDown": "change", "Unnamed: 4": "go_domains", "ID": "go_id", "Description": "go_description", "GeneRatio": "gene_ration", "BgRatio": "background_ratio", "geneID": "gene_symbol_list", "image_URL": "image_URL", "Targets": "targets_gene_symbol_list",
    },
    "opengenes": {
        "hgnc": "gene_symbol", "sex": "gender", "p_value": "pvalue", "doi": "article_doi", "pmid": "pubmed_id", "Gene name": "gene_description", "Effect on gene function, increased lifespan": "effect_on_gene_function",
        "Organism, ortholog and number of studies/entries* for data on increased lifespan": "species_orthologs",
    },
    "ctd": {
        "AnatomyName": "entity_name", "AltAnatomyIDs": "external_ids", "Code": "type_code", "GOTermName": "go_term_name", "GOTermID": "go_term_id", "HighestGOLevel": "highest_go_level", "GOName": "go_name", "GOID": "go_id", "PubMedIDs": "pubmed_id",
        "AltDiseaseIDs": "external_disease_ids", "AltGeneIDs": "external_gene_ids", "BioGRIDIDs": "biogrid_ids", "PharmGKBIDs": "pharmgkb_ids", "UniProtIDs": "uniport_ids", "reference": "pubmed_id", "studyfactors": "study_factors",
        "chemicalname": "chemical_name", "chemicalid": "chemical_id", "casrn": "cas_rn", "phenotypename": "phenotype_name", "phenotypeid": "phenotype_id", "comentionedterms": "co_mentioned_terms", "organismid": "organism_id",
        "interactionactions": "interaction_actions", "anatomyterms": "anatomy_terms", "inferencegenesymbols": "inference_gene_symbols", "pubmedids": "pubmed_id", "exposurestressors": "exposure_stressors", "studycountries": "study_countries", "exposuremarkers": "exposure_marker",
    },
}
OWN = {
    "ageanno__related_diseases": {"geneId": "ageanno_gene_id"}, "ageanno__gene_variation_coefficient": {"cell_type": "cell_type_list"}, "ageanno__tf_regulation": {"cell_type": "cell_type_list"},
    "ctd__anatomy": {"ParentIDs": "patent_ids"}, "ctd__chem_pathways_enriched": {"CorrectedPValue": "correlation_pvalue"},
}


def standard_names(table: str) -> dict[str, str]:
    """The standard name of each published column of a table."""
    renamed = RENAMED[table.split("__")[0]] | OWN.get(table, {})
    return {c: renamed.get(c) or (c if re.fullmatch(r"[a-z0-9_%-]+", c) else snake(c)) for c in TABLES[table].split("|")}


def read_listed(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed) of a table's files, whatever their charset and delimiter: its columns under their standard names, all strings."""
    rows, malformed = read_robust(spark, path)
    names = {c: n for c, n in standard_names(table).items() if c in rows.columns}
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), malformed
