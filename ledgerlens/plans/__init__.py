"""Plans put together from operators: the customer summary and the business questions."""
