"""Declared schemas of the landed tables (DDL strings, no inference)."""

RAW = {
    "clinical_data": (
        "study_id string, patient_id string, sample_id string, mutation_count bigint, "
        "tmb_nonsynonymous double, overall_survival_months double, overall_survival_status string, "
        "sex string, diagnosis_age bigint, smoker string, smoking_history string, "
        "stage_at_diagnosis string, oncotree_code string, t_stage string, n_stage string, m_stage string"
    ),
    "gene_expression": "gene_symbol string, sample_id string, expression_value double",
    "compounds": "nsc string, cas string, drug_name string",
    "cell_lines": "cell_line string, panel string",
    "experiments": (
        "experiment_id string, nsc string, highest_tested_concentration string, cell_line string, "
        "log_ec50 string, response_zero string, response_inflection string, hill_slope string, "
        "log_ic50 string, flag_ic50 string"
    ),
    "dose_response": (
        "experiment_id bigint, concentration double, mean_pct_ctrl double, "
        "stddev_pct_ctrl double, count_pct_ctrl bigint"
    ),
}

# Quoted headers of the clinical seed file.
CLINICAL_SEED_RENAMES = {
    "Study ID": "study_id",
    "Patient ID": "patient_id",
    "Sample ID": "sample_id",
    "Mutation Count": "mutation_count",
    "Diagnosis Age": "diagnosis_age",
    "Year of Diagnosis": "year_of_diagnosis",
    "Overall Survival (Months)": "overall_survival_months",
    "Progress Free Survival (Months)": "progress_free_survival_months",
    "Fraction Genome Altered": "fraction_genome_altered",
    "TMB (nonsynonymous)": "tmb_nonsynonymous",
    "Number of Samples Per Patient": "samples_per_patient",
}
