"""Personal information inside free text: candidates, a semi-Markov conditional random field, and replacement."""
