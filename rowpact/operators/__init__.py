"""DataFrame operators: cleansing, checking, validation, requests, outcomes, summaries."""
