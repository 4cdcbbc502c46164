"""Jobs on DataFrames: quality rules, demand, networks, metrics, siting, report figures."""
