"""Operations on training text: filters, near-duplicates, archives, mixes."""
