"""DataFrame operators over lexicons, forms and words."""
