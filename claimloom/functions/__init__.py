"""Part of claimloom; see README.md."""
