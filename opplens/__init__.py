"""Part of the opplens analytics engine."""
