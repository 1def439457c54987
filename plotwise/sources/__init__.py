"""Reading: footers, logs, traces, trials; and the feature generator."""
