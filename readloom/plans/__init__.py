"""What is planned on the driver: templates, sample sheets, run information, sessions."""
