"""DataFrame-to-DataFrame operators; case_id leads every key."""
