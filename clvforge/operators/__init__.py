"""DataFrame → DataFrame operators: cleaning, features, ranks, RFM, cohorts,
model value, target lists, reports and evaluation."""
