"""Reports, dashboards and the batch flow."""
