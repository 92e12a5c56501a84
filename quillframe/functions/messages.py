"""Texts that must read as they do."""

# Reasons, warnings and log lines by operator.
REASONS = {
    "question_empty": "Question cannot be empty.",
    "question_pattern": "Question contains disallowed patterns.",
    "sql_statement": "SQL query contains disallowed statements (DROP, DELETE, ALTER, etc.).",
    "code_empty": "Generated code is empty.",
    "code_operation": "Generated code contains disallowed operations.",
    "code_result": "Generated code must assign output to 'result_df'.",
    "code_long": "Generated code exceeds length limit.",
    "json_invalid": "LLM response is not valid JSON.",
    "insights_missing": "Missing 'insights' key in LLM response.",
    "insights_list": "'insights' must be a list.",
    "question_long": "Question exceeds {limit} character limit.",
    "sql_long": "SQL query exceeds {limit} character limit.",
    "one_number": "Needs ≥1 numeric column.",
    "time_axis": "Needs a datetime or categorical x-axis.",
    "small_category": "Needs a categorical column with ≤10 unique values. Found cardinalities: ",
    "category_axis": "Needs a categorical or datetime x-axis.",
    "categories_cut": "'%s' has %d categories — top 20 shown.",
    "two_numbers": "Needs ≥2 numeric columns; found ",
    "three_numbers": "Needs ≥3 numeric columns (x, y, size); found ",
    "matrix": "Needs ≥2 numeric columns for correlation matrix.",
    "axes": "Needs ≥3 numeric columns for axes; found ",
    "axes_cut": "Radar chart truncated to 10 axes for readability.",
    "label_and_number": "Needs ≥1 categorical and ≥1 numeric column.",
    "number_and_axis": "Needs a numeric column and a category/date column.",
    "stage_and_value": "Needs a stage (categorical) and value (numeric) column.",
    "stages_many": "Funnel needs ≤12 stages; '%s' has %d.",
    "four_numbers": "Needs 4 numeric columns (open, high, low, close); found ",
    "source_and_target": "Needs 2 categorical columns (source, target) and 1 numeric column.",
    "null_share": "'%s' is %.1f%% null",
    "duplicates_share": "%d duplicate rows (%.1f%%)",
    "duplicates": "%d duplicate rows",
    "missing_share": "'%s' has %s%% missing values.",
    "score_low": "Data quality score is low (%s/100).",
    "made_dates": "Extracted year/month/dayofweek from '{}'",
    "made_scaled": "Z-score scaled '{}'",
    "made_logged": "Log-transformed '{}'",
    "made_encoded": "Label encoded '{}'",
}

#: What to do about a finding, by its category.
ACTIONS = {
    "diagnostic": "Check whether '%s' drives '%s' or both follow something else.",
    "anomaly": "Review the rows of '%s' beyond the fences before averaging it.",
    "descriptive": "Fill '%s' or leave its empty rows out.",
    "predictive": "Plan for '%s' going on %s.",
}
