"""Views that let the star schema stand in for the graph's tables, and the queries over them."""
