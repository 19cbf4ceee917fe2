"""Named queries, each a function of a session and a data folder, with SQL for those SQL can express."""


def modules():
    from ionloom.queries import interval, peptide, plans, prep, readers, series, stats

    return [prep, interval, series, peptide, stats, plans, readers]
