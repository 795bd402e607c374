"""Query model, planner, query language and plan support."""
