"""Sources: pages, macros, diagrams, rules and slides as DataFrames."""
