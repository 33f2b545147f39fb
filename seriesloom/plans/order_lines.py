"""Scores of order lines dm(cand, dist, label) in SQL.

All literals are doubles: decimal ones round differently between engines.
"""

from __future__ import annotations

#: Best split by information gain (natural logarithm), ties by the larger gap, then the smaller threshold; lines
#: whose distances are all equal give no row.
GAIN = """
with o as (select cand, dist, label, count(*) cnt from {dm} group by 1,2,3),
lc as (select cand, label, sum(cnt) tot from o group by 1,2),
dv as (select cand, dist, sum(cnt*dist) s, lead(dist) over (partition by cand order by dist) nxt from o group by 1,2),
cs as (select *, sum(s) over (partition by cand order by dist rows unbounded preceding) sl_dist,
              sum(s) over (partition by cand) st_dist from dv),
grid as (select cs.cand, cs.dist, cs.nxt, cs.sl_dist, cs.st_dist, lc.label, lc.tot, coalesce(o.cnt,0) cnt
         from cs join lc on cs.cand=lc.cand
         left join o on o.cand=cs.cand and o.dist=cs.dist and o.label=lc.label),
cum as (select *, sum(cnt) over (partition by cand, label order by dist rows unbounded preceding) l from grid),
sp as (select cand, dist, nxt, max(sl_dist) ld, max(st_dist) td, sum(l) nl, sum(tot-l) nr,
              sum(case when l>0 then l*ln(l) else 0e0 end) hl,
              sum(case when tot-l>0 then (tot-l)*ln(tot-l) else 0e0 end) hr, sum(tot*ln(tot)) ht
       from cum group by 1,2,3),
g as (select cand, (dist+nxt)/2 tau,
             round((ln(nl+nr)-ht/(nl+nr)) - (nl*ln(nl)-hl+nr*ln(nr)-hr)/(nl+nr), 9) gain,
             round((td-ld)/nr - ld/nl, 9) gap
      from sp where nxt is not null),
r as (select *, row_number() over (partition by cand order by gain desc, gap desc, tau) rn from g)
select cand, round(gain,6) gain, round(gap,6) gap, round(tau,6) tau from r where rn=1
"""

#: One-way ANOVA F.
F_SCORE = """
with g as (select cand,label,count(*) n,avg(dist) m,sum(dist) s,coalesce(var_samp(dist),0e0)*(count(*)-1) ss from {dm} group by 1,2),
t as (select *, sum(s) over (partition by cand)/sum(n) over (partition by cand) gm from g)
select cand, round((sum(n*(m-gm)*(m-gm))/nullif(count(*)-1,0))/nullif(sum(ss)/nullif(sum(n)-count(*),0),0e0),6) score from t group by 1
"""

#: Kruskal-Wallis H with the correction for ties.
KRUSKAL = """
with r as (select *, rank() over (partition by cand order by dist)+(count(*) over (partition by cand,dist)-1)/2e0 rk, count(*) over (partition by cand) nn, count(*) over (partition by cand,dist) tt from {dm}),
g as (select cand,label,nn,sum(rk) sr,count(*) n from r group by 1,2,3),
tie as (select cand, sum(cast(tt as double)*tt-1) t3 from r group by 1)
select g.cand, round((12e0/(max(nn)*(max(nn)+1))*sum(sr*sr/n)-3*(max(nn)+1))/nullif(1-max(t3)/nullif(cast(max(nn) as double)*max(nn)*max(nn)-max(nn),0e0),0e0),6) score from g join tie on g.cand=tie.cand group by 1
"""

#: Mood's median test: chi-square of counts above the common median; with two classes less Yates' correction.
MOOD = """
with m as (select cand, median(dist) med from {dm} group by 1),
g as (select dm.cand,label,cast(sum(case when dist>med then 1 else 0 end) as double) a,cast(count(*) as double) n from {dm} dm join m on dm.cand=m.cand group by 1,2),
t as (select *, sum(a) over (partition by cand) ra, sum(n) over (partition by cand) nn, count(*) over (partition by cand) k from g),
u as (select cand, k, abs(a-n*ra/nn) d, n*ra/nn ea, n*(nn-ra)/nn eb from t),
w as (select cand, case when k=2 then d-least(5e-1,d) else d end d, ea, eb from u)
select cand, round(sum(d*d/nullif(ea,0e0)+d*d/nullif(eb,0e0)),6) score from w group by 1
"""

SCORES = {"ig": GAIN, "f": F_SCORE, "kw": KRUSKAL, "mm": MOOD}
